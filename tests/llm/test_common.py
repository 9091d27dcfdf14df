import random
import re

import numpy as np
import pytest

from caselake.llm import common as C


def thue_morse(n, letters="ab"):
    """Two strings of n letters, the second the first with its letters exchanged."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def words_of(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return C.Words(np.frombuffer(b"".join(raw), np.uint8), offsets)


def test_words_have_equal_hashes_only_where_they_are_equal():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aàb\x00界") for _ in range(rng.randrange(1, 12))) for _ in range(300)) for _ in range(20)]
    texts += ["", " \n", "a a\x00 a\x00\x00", " ".join(w for n in (16, 17, 256, 512, 1024, 2048, 4096) for w in thue_morse(n))]
    words = words_of(texts)
    flat = [w for t in texts for w in re.findall(C.WORD, t)]
    hashes = [tuple(h) for h in C.word_hashes(words).T.tolist()]
    assert len(flat) == len(hashes)
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len({h[0] for h in hashes}) == len({h[1] for h in hashes})


@pytest.mark.parametrize("k", [1, 2, 3, 5, 12, 35])
def test_phrases_have_equal_hashes_only_where_they_are_equal(k):
    rng = random.Random(k)
    flat = [rng.choice("ab") for _ in range(400)] + [w for n in (64, 512) for t in thue_morse(n) for w in t]
    hashes = C.phrase_hashes(C.word_hashes(words_of([" ".join(flat)])), k)
    phrases = [tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)]
    assert hashes.shape == (2, len(phrases))
    for row in hashes.tolist():
        assert len(set(zip(phrases, row))) == len(set(phrases)) == len(set(row))
    assert C.phrase_hashes(C.word_hashes(words_of(["a b"])), 5).shape == (2, 0)


def test_whole_texts_have_equal_hashes_only_where_they_are_equal():
    texts = [" ".join(t) for n in (64, 512, 1024, 2048) for t in thue_morse(n)] + ["", "  ", "a  b", "a\tb"]
    words = words_of(texts)
    got = C.sequence_hashes(words, C.word_hashes(words)).T.tolist()
    assert len({tuple(g) for g in got}) == 10 and got[-1] == got[-2] and got[8] == got[9]


def test_passing_tables_are_deleted_and_lasting_ones_stay(spark):
    with C.passing(spark):
        gone = C.written(spark.range(3), "gone")
        stays = C.written(gone.where("id > 0"), "stays", lasting=True)
    assert stays.count() == 2
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such"):
        spark.read.parquet(gone.inputFiles()[0])
    assert spark.conf.get(C.ARROW_KEY, None) in (None, "67108864", C.ARROW_BYTES, "64MB", "67108864b")


def test_lasting_tables_belong_to_the_block_around(spark):
    def there(df):
        try:
            return spark.read.parquet(df.inputFiles()[0]).count() >= 0
        except Exception:
            return False

    with pytest.raises(ValueError), C.passing(spark):
        with C.passing(spark):
            inner = C.written(spark.range(3), "inner")
            classes = C.written(spark.range(3), "classes", lasting=True)
            files = [df.select("id") for df in (inner, classes)]
        assert not there(files[0]) and there(files[1])
        result = C.written(spark.range(3), "result", lasting=True)
        raise ValueError
    assert not there(files[1]) and there(result)
