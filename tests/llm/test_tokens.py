import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from llm_cases import nothing, odd, sf  # noqa: F401  fixtures
from ledgerflow.llm import dac_tokens as D
from ledgerflow.llm import unigram_count as U


def test_any_token_is_read_without_the_others():
    random.seed(2)
    for size in (1, 7, 511, 512, 513, 4000):
        ids = np.array([random.choice([1, 200, 255, 256, 40000, 70000, 2**31]) for _ in range(size)], "<u4")
        seg = D.Segment(D.pack_segment([5, None], np.array([0, size // 2, size]), ids, 9))
        assert seg.doc_ids == [5, None] and seg.before == 9
        assert [seg.token(i) for i in range(0, size, 3)] == ids[::3].tolist()
        lo, hi = sorted(random.sample(range(size + 1), 2)) if size > 1 else (0, 1)
        assert seg.tokens(lo, hi).tolist() == ids[lo:hi].tolist()


def test_chunks_give_the_tokenizer_s_ids():
    path = D.tokenizer_path()
    own, whole = D.Encoder(path), Tokenizer.from_file(path)
    random.seed(3)
    parts = list("abcXYZ019 .,!?'’-_<|>\n\t éÉßİKǅŉ日本😀́̇ªº²½ñÑ") + ["'s", "<|endoftext|>", "  ", "the "]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_token_output_reads_back_what_the_tokenizer_gives(spark, odd, nothing):
    whole = Tokenizer.from_file(D.tokenizer_path())
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    want = sorted((d if known else None, zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()))
                  for known, d, t in rows if known)
    got = D.token_output(odd).orderBy("start").collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] or 0 for r in got] == sorted(r["doc_id"] or 0 for r in got)
    assert D.token_output(nothing).count() == 0


def test_starts_run_through_many_segments_and_ranges(spark):
    docs = spark.createDataFrame([(k, "some words " * (k % 7)) for k in range(200)], "doc_id long, text string").repartition(5)
    segments = D.encode_segments(docs, segment_ids=40)
    got = D.read_documents(D.stored(segments, "test-segments")).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


@pytest.fixture(scope="module")
def vocabulary():
    return U.Vocabulary(U.model_pieces(U.vocabulary_path()))


def test_counts_are_the_unigram_tokenizer_s(sf, spark, vocabulary, odd, nothing):
    scored = U.model_pieces(U.vocabulary_path())
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], unk_id=0, byte_fallback=True))
    for text in ["", " ", "     ", "  a  b   c ", "\n\n tab\t", "日本語 😀😀 x", "𐍈𐍈 a", "x\x00ý z"]:
        marked = text.replace(" ", U.MARK)
        assert vocabulary.count(text)[1] == len(whole.encode(marked).ids) == vocabulary.best(marked)[1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = U.count_tokens(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    for r in got[:60]:
        assert r["n_tokens"] == len(whole.encode(texts[r["doc_id"]].replace(" ", U.MARK)).ids)
    assert U.count_tokens(odd).count() == odd.count() and U.count_tokens(nothing).count() == 0


def test_ties_and_unknowns_follow_the_tokenizer():
    random.seed(5)
    for _ in range(300):
        scored = list({"".join(random.choice("abc") for _ in range(random.randint(1, 3))): float(-random.randint(1, 6)) for _ in range(6)}.items())
        own, whole = U.Vocabulary(scored, False), Tokenizer(models.Unigram([("<unk>", 0.0), *scored], unk_id=0, byte_fallback=False))
        text = "".join(random.choice("abcd") for _ in range(random.randint(0, 12)))
        assert own.best(text)[1] == len(whole.encode(text).ids)


def test_tables_stay_bounded_with_texts_without_blanks():
    path = D.tokenizer_path()
    own, whole = D.Encoder(path), Tokenizer.from_file(path)
    random.seed(8)
    held = 0
    for _ in range(40):
        texts = ["".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(random.randint(100, 1500))) for _ in range(50)]
        got = own.ids([t.encode() for t in texts])
        assert np.frombuffer(got[0], "<u4").tolist() == whole.encode(texts[0], add_special_tokens=False).ids
        held = max(held, own.known.held + own.cores.held)
    assert held < 1_000_000 and not own.known and not own.cores


def test_a_small_table_keeps_frequent_words_and_gives_the_same_ids():
    path = D.tokenizer_path()
    own, whole = D.Encoder(path), Tokenizer.from_file(path)
    own.known, own.cores = D.WordTable(None, 40_000), D.WordTable(None, 20_000)
    random.seed(9)
    for _ in range(60):
        text = " ".join(random.choice(["the", "of", "and"]) if random.random() < 0.5 else "".join(random.choices("abcdefg,'", k=6)) for _ in range(200))
        assert np.frombuffer(own.ids([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert own.known.held <= 20_000 + 200 * 400 and (b"the" in own.known or b"the" in own.known.old)


def test_word_table_makes_each_frequent_word_once():
    made = Counter()
    table = D.WordTable(lambda w: made.update([w]) or w[::-1], 60_000)
    for k in range(20_000):
        assert table[b"often"] == b"netfo" and table[b"%d" % k] == (b"%d" % k)[::-1]
        assert table[b"x" * 100] == b"x" * 100
    assert made[b"often"] == 1 and table.held <= 60_000 and b"x" * 100 not in table


def test_a_piece_takes_few_bytes_beside_its_text():
    own, text = D.Encoder(D.tokenizer_path()), b"the quick brown fox, jumps over 12 lazy dogs. \n" * 40000
    own.unit_ids([text[:1000]])
    tracemalloc.start()
    own.unit_ids([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(text)


def test_a_unit_is_remembered_once():
    own = D.Encoder(D.tokenizer_path())
    own.ids([b"alpha beta 12, gam\xc3\xa9, gamma's, ..."])
    assert b"alpha" in own.known and b"alpha" not in own.cores and not set(own.known) & set(own.cores)


def test_a_packed_table_keeps_frequent_words_in_few_bytes():
    table = D.PackedTable(60_000)
    for k in range(0, 20_000, 100):
        words = [b"often", b"x" * 100, *(b"%d" % j for j in range(k, k + 100))]
        found = table.find(words)
        assert found[0] == (b"netfo" if k else None) and set(found[1:]) == {None}
        table.keep_all(words, [w[::-1] for w in words])
        assert table.find(words[2:]) == [w[::-1] for w in words[2:]] and b"x" * 100 not in table
        assert table.held <= 60_000 and len(table) == len(set(table))
    assert len(table) > 60_000 // 2 // 45  # a dict of bytes holds a third of these


def test_a_packed_table_tells_apart_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(D.PackedTable, "_hashes", staticmethod(lambda data, edge: np.zeros(len(edge) - 1, np.uint64)))
    table = D.PackedTable()
    table.keep_all([b"ab", b"cd"], [b"1", b"2"])
    table.keep_all([b"cd", b""], [b"2", b"3"])
    assert table.find([b"cd", b"ab", b"", b"a"]) == [None, b"1", None, None] and len(table) == 1


def test_small_ascii_words_skip_what_leaves_them_as_they_are():
    own = D.Encoder(D.tokenizer_path())
    words = [b"the", b"quick", b"brownfoxes", b"zzyzx"]
    assert own.plain is not own.tokenizer and own.word_ids(words, True) == own.word_ids(words, False)
