"""Stored token ids: against the library text by text, order and places, files, pruning, odd rows."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest

from driftpanel.llm import token_store
from driftpanel.llm.tokens import model_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_path(token_store.MODEL))


def brute_force(rows, tokenizer):
    """Rows of ``doc_id, start, n_tokens, crc`` in id order, null last, by the library on whole texts."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [
    None, "", " \t\r\n\x0b\x0c ", "Hello  World", "hello<|endoftext|>x <|startoftext|>", "a\x00b \x1c x\x85y", "É é 　x ́y", "don't ''s 12345 !!!abc",
    "İ ẞ ΑΣ ΑΣΑ ﬁ Å", "漢字かな交じり文" * 50, "    ​", "\x02 a\x02b \x02", "x" * 50_000, "many words here " * 30_000,
]


def test_whole_texts_equal_the_library(spark, documents, tokenizer, tmp_path):
    rng = random.Random(3)
    alphabet = ["the", "İstanbul", "Straße", "'s", "'LL", "é", "́", "<|endoftext|>", "12", "½", "…", "　", "'", "\x85", "σς"]
    texts = ODD + ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n", "\t "]) for _ in range(30)) for _ in range(200)]
    rows = list(zip(rng.sample(range(-500, 500), len(texts)), texts, strict=True))
    docs = documents(*[(i, t, "en", "s", 1) for i, t in rows])
    path = str(tmp_path / "ids")
    token_store.write_ids(docs, path, file_bytes=100_000)
    got = sorted((tuple(r) for r in token_store.digests(spark, path).collect()), key=lambda r: r[1])
    assert got == brute_force(rows, tokenizer)
    assert len(glob.glob(path + "/*.orc")) > 3


def test_null_and_shared_ids_and_repeated_rows(spark, documents, tokenizer):
    rows = [(None, "b c"), (None, "a"), (None, None), (5, "same"), (5, "same"), (5, "other text"), (-1, "first"), (None, "a")]
    docs = documents(*[(i, t, "en", "s", 1) for i, t in rows], extra="n int, ids string, first string, part string, key int, row int", values=(1, "i", "f", "p", 2, 3))
    got = sorted((tuple(r) for r in token_store.store_digests(docs).collect()), key=lambda r: r[1])
    want = brute_force(rows, tokenizer)
    assert sorted((r[0] is None, r[0], r[2], r[3]) for r in got) == sorted((r[0] is None, r[0], r[2], r[3]) for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])[:-1]].tolist()


def test_no_rows(spark, documents):
    assert token_store.store_digests(documents().where("false")).collect() == []


def test_a_third_of_the_ids_null_are_cut_into_files(spark, documents, tmp_path):
    docs = documents(*[(None if i % 3 == 0 else i, f"text {i} " * 50, "en", "s", 1) for i in range(900)])
    path = str(tmp_path / "ids")
    token_store.write_ids(docs, path, file_bytes=40_000)
    sizes = [r["count"] for r in token_store.read_ids(spark, path).groupBy("part").count().collect()]
    assert max(sizes) < 3 * 900 / len(sizes) and len(sizes) > 8


def rows_scanned(frame) -> int:
    """Rows that came out of the scan itself."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            found += metrics.apply("numOutputRows").value()
    return found


def test_indexes_and_bloom_filters_prune(spark, documents, tmp_path):
    ids = random.Random(1).sample(range(0, 400_000, 2), 40_000)
    docs = spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string")
    path, scattered = str(tmp_path / "ids"), str(tmp_path / "scattered")
    token_store.write_ids(docs, path, file_bytes=1 << 18, options={"orc.row.index.stride": "1000"})
    found = token_store.lookup(spark, path, [ids[7]])
    assert [(r.doc_id, len(r.ids)) for r in found.collect()] == [(ids[7], 2)]
    assert rows_scanned(token_store.lookup(spark, path, [ids[7]])) <= 1000
    # rows out of order: ranges of the row index hold every id, only the Bloom filter can tell
    shuffled = token_store.read_ids(spark, path).orderBy(token_store.F.xxhash64("doc_id"))
    shuffled.coalesce(1).write.options(**token_store.ORC).option("orc.row.index.stride", "1000").orc(scattered)
    absent = [rows_scanned(token_store.lookup(spark, scattered, [i])) for i in range(100_001, 100_041, 2)]
    assert sorted(absent)[10] <= 2000 and sum(absent) < 20 * 40_000 / 4


def test_stripes_cover_the_file_and_are_read_apart(spark, documents, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    docs = documents(*[" ".join(rng.choices(words, k=400)) for _ in range(3000)])
    path = str(tmp_path / "ids")
    token_store.write_ids(docs, path, options={"orc.stripe.size": "200000", "compression": "none"})
    file = orc.ORCFile(glob.glob(path + "/*.orc")[0])
    assert file.nstripes > 2
    whole = file.read().column("doc_id").to_pylist()
    stripes = [file.read_stripe(i).column(1).to_pylist() for i in range(file.nstripes)]
    assert sum(stripes, []) == whole == sorted(whole)
    # run lengths: ids of two bytes, not four
    assert file.content_length < 0.6 * 4 * sum(token_store.read_ids(spark, path).agg({"n": "sum"}).first())


def test_a_full_word_table_changes_nothing(tokenizer):
    rng = random.Random(8)
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    small = token_store.WordIds(encode, remembered=20)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "İs", "x\x02y", f"w{rng.randrange(90)}", "<|endoftext|>"]) for _ in range(rng.randrange(12))) for _ in range(3)]
        ids, n = small([t.encode() for t in texts], end_id=2)
        want = [[*e, 2] for e in encode(texts)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_words_of_latin_letters_equal_the_library(tokenizer):
    """Words that go to the model without the pre-tokenizer, and others beside them; the encoder is in use for this vocabulary."""
    latin = [c for c in map(chr, range(256)) if c.isalpha()]
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    words = latin + [a + b for a in latin for b in latin[::7]] + [f"Th{a}on{s}" for a in latin[::9] for s in signs] + [f"Heat{s}{t}" for s in signs for t in signs]
    words += ["Heat,", "\u00c9t\u00e9", "e\u0301t\u00e9", "it's", "IT'S", "d'été", "été's", "été", "naïvé", "straße", "İx", "ﬁn", "日本語", "Ǆx", "été***", "xʼy", "a1", "1a", "é1!", "<|endoftext|>"]
    letters = token_store.letter_encoder(tokenizer)
    assert letters is not None
    asked = []

    def plain(texts):
        asked.extend(texts)
        return letters[0](texts)

    encode = lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    ids, n = token_store.WordIds(encode, letters=(plain, letters[1]))([w.encode() for w in words])
    expected = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert n.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]
    sent = set(" ".join(asked).split())
    assert {"stra\u00dfe", "\u00e9t\u00e9", "heat"} <= sent and not any(c in w for w in sent for c in signs)


def test_words_are_encoded_once_whatever_case_and_signs(tokenizer):
    """Capitals and signs behind letters make no new word for the library; look-alikes stay whole."""
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    words = [stem + end for stem in ("heat", "Heat", "HEAT", "été") for end in ("", ",", "###", ".&&&", ",%%%", "!!")]
    odd = [f"{a}{s}{t}" for a in ("été", "a×", "×", "÷", "ª", "1", "é", "日本", "") for s in signs for t in ["", *signs[::5]]]
    odd += ["a×b.", "heat<|endoftext|>", "<|endoftext|>###", "été'S", "IT'S!", "''s", "x_y_", "_x", "###heat", "Ã###", "ßÿ..", "İ..", "ﬁ!!"]
    letters = token_store.letter_encoder(tokenizer)
    asked = []

    def noted(take):
        def run(texts):
            asked.extend(w for t in texts for w in t.split(" ") if w not in ("", token_store.MARK))
            return take(texts)

        return run

    encode = noted(lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
    known = token_store.WordIds(encode, letters=(noted(letters[0]), letters[1]))
    expected = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for some in (words, words[::-1]):
        ids, n = known([" ".join(some).encode(), b""])
        wanted = expected if some is words else expected[::-1]
        assert n.tolist() == [sum(map(len, wanted)), 0] and ids.tolist() == sum(wanted, [])
    assert sorted(asked) == sorted(["heat", "été", ",", "###", ".&&&", ",%%%", "!!"])
    ids, n = known([w.encode() for w in odd])
    expected = [tokenizer.encode(w, add_special_tokens=False).ids for w in odd]
    assert n.tolist() == [len(e) for e in expected] and ids.tolist() == sum(expected, [])


def test_bytes_that_are_no_utf8_count_as_replacements(tokenizer):
    words = [b"heat\xc3.", b"\xc3", b"a\xc3\xc3b##", b"\x97,", b"ok,", b"\xc3\x97.", b"Heat"]
    encode = lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    known = token_store.WordIds(encode, letters=token_store.letter_encoder(tokenizer))
    for texts in ([b"Heat, heat."], [b" ".join(words), b"Heat,"], [b"Heat, heat."]):
        ids, n = known(texts)
        expected = [tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(e) for e in expected] and ids.tolist() == sum(expected, [])


def test_a_vocabulary_with_capitals_gets_words_as_they_are():
    """Without the letters' encoder nothing is lower-cased or taken apart."""
    encode = lambda texts: ([ord(c) for c in t if not c.isspace()] for t in texts)
    ids, n = token_store.WordIds(encode)([b"Heat, HEAT", b" x", b""], end_id=0)
    assert n.tolist() == [10, 2, 1]
    assert ids.tolist() == [*map(ord, "Heat,HEAT"), 0, ord("x"), 0, 0]
