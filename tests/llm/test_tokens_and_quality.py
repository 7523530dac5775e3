"""SentencePiece against its library; quality rules against plain Python."""

import hashlib
import random
import re

import pytest

from vacantia.llm import ngram_quality as q
from vacantia.llm import piece_bpe as p

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  a  b ", "\n\n x\t", "a" * 5000, "</s> <s> <0x41> <unk>", "▁▁x ▁", "naïve café 中文 😀‍ é", "\x00\x01", "of the and tion", "é" * 3000, "x\r\ny"]


@pytest.fixture(scope="module")
def vocabulary():
    return p.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoder_equals_library(vocabulary, library):
    e, rng = p.Encoder(vocabulary, words=50, pairs=50), random.Random(3)  # tiny memories, so that they turn over
    texts = HARD + ["".join(rng.choice([" ", "\n", "▁", "a", "b", "the", "ing", "é", "中", "😀", *vocabulary["pieces"][300:900]]) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    for t in texts:
        ids = e.encode(t)
        assert ids == library.encode(t, add_eos=True), t
        assert e.decode(ids) == library.decode(ids), t


def test_decode_of_any_ids(vocabulary, library):
    e, rng = p.Encoder(vocabulary), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 2, 1]) for _ in range(rng.randint(0, 6))]
        assert e.decode(ids) == library.decode(ids), ids


def test_tokens_query(spark, frame, vocabulary, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (3, "same id"), (3, "same id")]
    got = {(r["id"], tuple(r["ids"]), r["decoded"]) for r in p.encode_decode(frame(rows), vocabulary).collect()}
    assert got == {(i, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or ""))) for i, t in rows}
    assert p.encode_decode(frame(rows), vocabulary).count() == len(rows)
    assert p.encode_decode(frame([]), vocabulary).collect() == []


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "a b c", "a a a a", "x y z\nx y z\n\nx y z ", "é#é * <b>\x0bnext word", "one two three four one two three"])
def test_base_counts(text):
    assert q.base_counts(text, q.WORD.findall(text or "")) == plain_counts(text)


def test_base_counts_random():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "d# ", "\n", " "]) for _ in range(rng.randint(0, 60)))
        assert q.base_counts(text, q.WORD.findall(text)) == plain_counts(text)


def test_quality_rejects_what_the_target_lacks(spark, frame):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(400)]
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(120))
    noisy = lambda: " ".join(rng.choice(vocabulary) + "%%%" for _ in range(120))
    rows = [(i, clean() if i % 4 else noisy(), None, None, None) for i in range(80)] + [(100, None), (101, ""), (102, "few words"), (103, "again " * 200), (None, clean()), (5, clean())]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(40)] + [(None, 1, 1), (999, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, text string")
    got = q.quality(frame(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["kept"] == (r["id"] is None or r["id"] < 100 and (r["id"] % 4 > 0)), r
    again = {(r["id"], r["n_words"], r["score"], r["kept"]) for r in q.quality(frame(rows[::-1]), labels).collect()}
    assert again == {(r["id"], r["n_words"], r["score"], r["kept"]) for r in got}
    assert q.quality(frame([]), labels).collect() == []
    unlabelled = q.quality(frame(rows), labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_threshold():
    assert q.best_threshold([]) is None
    assert q.best_threshold([(0.1, True, 5)]) is None
    assert q.best_threshold([(-1.0, False, 2), (0.5, True, 3)]) == -0.25
    assert q.best_threshold([(-1.0, True, 2), (0.5, False, 3)]) == -1.0


def test_digest_columns(spark, vocabulary, library):
    from vacantia.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op9_sentencepiece"](spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
