"""Encoding, decoding and counting against the library; character maps; transducer composition."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces, tokencount

PATH = pieces.default_model()
ODD = ["", " ", "  a  b ", "▁a b", "a\x00b\n\n c\t d", "日本語 テキスト 🎉🎉", "<s> </s> <unk> <0x41>", "é é ​ x", "a" * 3000, "▁▁ ▁x", "x ", " x", "\n", "ﬁ ① ½", "=-" * 400, "   " * 50 + "x", "int main() {\n\t\t// hello     world", "3.14 aaaaabbbbb", "word " * 20_000]
texts = st.text(alphabet=st.sampled_from(list("abcdeinorst ▁.,\n\té日🎉0#ABCthe ")), max_size=120)


def expected(text: str) -> tuple[int, str, str]:
    lib = pieces.codec(PATH).library
    ids = lib.encode(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else "")


@pytest.mark.parametrize("text", ODD)
def test_digest_and_count_are_the_librarys(text):  # noqa: ANN001
    got = pieces.codec(PATH).digest(text)
    assert got[:3] == expected(text)
    assert got[4] and got[3] == len(text.encode())
    assert tokencount.counter(PATH).count(text) == got[0]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_any_text(text):  # noqa: ANN001
    assert pieces.codec(PATH).digest(text)[:3] == expected(text)
    assert tokencount.counter(PATH).count(text) == expected(text)[0]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_spans_are_the_librarys(text):  # noqa: ANN001
    c = pieces.codec(PATH)
    got, raw = c.encode(text), text.encode()
    ours = [(i, raw[a:b].decode()) for i, a, b in zip(got.ids, got.begins, got.ends)]
    assert ours == [(p.id, p.surface) for p in c.library.encode(text, return_type="proto").pieces]


def test_memory_of_words_does_not_change_results(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(pieces, "MEMO", 10)
    c = pieces.Codec(PATH)
    for text in ODD:
        assert c.digest(text)[:3] == expected(text)
    monkeypatch.setattr(tokencount, "STATES", 3000)
    monkeypatch.setattr(tokencount, "WORDS_KEPT", 10)
    t = tokencount.Counter(PATH)
    for text in ["some ordinary words of a text", "other words, none alike: zebra", *ODD[:6]]:
        assert t.count(text) == expected(text)[0]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_maps(rule):  # noqa: ANN001
    for dummy in (True, False):
        for tight in (True, False):
            lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=tight, escape_whitespaces=True)
            own = pieces.Normalizer(pieces.parse_model(lib.serialized_model_proto()))
            for text in [*ODD[:16], "Ａ ﷺ ㍿ Å ͈ é  ﬃ", "ÀÉ ẞ İ"]:
                normal, places = own.normalize(text)
                assert normal.decode() == lib.normalize(text)
                assert len(places) == len(normal) + 1 and all(a <= b for a, b in zip(places, places[1:]))
                assert places[-1] <= len(text.encode())


def test_alignment_of_a_changed_text():
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    own = pieces.Normalizer(pieces.parse_model(lib.serialized_model_proto()))
    assert own.normalize("aﬁb") == (b"afib", [0, 1, 1, 4, 5])


def test_transducer_chunks_compose():
    c = tokencount.counter(PATH)
    rng = random.Random(1)
    for text in [*ODD[:17], "plain words in a row " * 9]:
        normal = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else ""
        if not normal:
            continue
        whole = c.prefix_counts(normal, len(normal))[-1]
        for size in (1, 7, 64, rng.randint(2, 200)):
            assert c.prefix_counts(normal, size)[-1] == whole == c.total(normal, size)
        maps = [c.chunk_map(normal[k : k + 5]) for k in range(0, len(normal), 5)][:40]
        if len(maps) >= 3:
            left = c.compose(c.compose(maps[0], maps[1]), maps[2])
            right = c.compose(maps[0], c.compose(maps[1], maps[2]))
            assert c.enter(left) == c.enter(right)


@pytest.mark.parametrize("unit", ["abcdefghij", "x", "\u65e5", "word "])
def test_prefixes_and_totals_in_small_chunks(unit):  # noqa: ANN001
    c = tokencount.counter(PATH)
    text = "\u2581" + (unit * 200).replace(" ", "\u2581")
    for size in (1, 3, 7, 50):
        assert c.prefix_counts(text, size) == [c.transducer.run(text[: k + size])[1] for k in range(0, len(text), size)]
        assert c.total(text, size) == c.transducer.run(text)[1]


def test_a_text_of_ten_million_characters_without_a_space():
    c, text = tokencount.counter(PATH), "abcdefghij" * 1_000_000
    start = time.perf_counter()
    got = c.count(text)
    assert time.perf_counter() - start < 60
    assert got == expected(text)[0]


def test_scan_is_a_prefix_sum():
    assert tokencount.scan([1, 2, 3, 4, 5], lambda a, b: a + b) == [1, 3, 6, 10, 15]
    assert tokencount.scan([], lambda a, b: a + b) == []


def test_frames(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (3, "two words", "x")], "doc_id long, text string, n_tokens string")
    got = pieces.digests(df, PATH).select("doc_id", "_p.*").collect()
    assert [r.n_tokens for r in got] == [0, 0, expected("two words")[0]] + [expected("two words")[0]]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    e = pieces.encode(df, PATH)
    back = pieces.decode(e, PATH).collect()
    assert [r.decoded for r in back] == ["", "", "two words", "two words"]
    assert [len(r.begins) for r in back] == [len(r.ids) for r in back]
    assert pieces.digests(df.limit(0), PATH).count() == 0
    counts = tokencount.count_tokens(df, PATH).collect()
    assert [r.n_tokens for r in counts] == [r.n_tokens for r in got]


def test_json_tokenizers_are_counted_too(spark):  # noqa: ANN001
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",), (None,)], "text string")
    assert [r.n_tokens for r in tokencount.count_tokens(df, path).collect()] == [len(Tokenizer.from_file(path).encode("hello world").ids), 0]


def test_queries_over_whole_tables(spark):  # noqa: ANN001
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op2_sentencepiece(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(docs[r.doc_id]) and r.spans_tile
    got = tokencount.op3_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == expected(docs[r.doc_id])[0] and r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096) for r in got)
