import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexstrata.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(automaton, text):
    return np.frombuffer(automaton.encode(text), dtype="<u4").tolist()


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_strings(automaton, library):
    rng = random.Random(1)
    common = "aabehilnorst 'ééΣß中1２‍́<|>\x1c\n࣑"
    for k in range(3000):
        s = "".join(rng.choice(common) if rng.random() < 0.95 else chr(rng.randrange(1, 0xD800)) for _ in range(rng.randrange(1, 40)))
        s = f"{s}<|endoftext|>{s}<|startoftext" if k % 7 == 0 else s
        assert ids_of(automaton, s) == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_characters_of_every_kind(automaton, library):
    """All code points of the first planes' scripts, every 61st of the others."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x11000 or c % 61 == 0)]
    for at in range(0, len(points), 128):
        s = "".join(f"a{chr(c)}b1{chr(c)}! " for c in points[at : at + 128])
        assert ids_of(automaton, s) == library.encode(s, add_special_tokens=False).ids


def test_long_words(automaton, library):
    for s in ("a" * 100_001, "é" * 50_000, "the" * 30_000, "=" * 40_000, "ab" * 777, "aaa", "ababa", "'" * 999):
        assert ids_of(automaton, s) == library.encode(s, add_special_tokens=False).ids, s[:8]


def test_the_automaton_accepts_one_sequence(automaton):
    """Of all token sequences that spell a short word, just one is a path."""

    def all_paths(data, at=0, last=None):
        if at == len(data):
            return [[]]
        return [[t, *rest] for end, t in automaton._spelled(data, at) if last is None or automaton.follows(last, t) for rest in all_paths(data, end, t)]

    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choice("aeinrsth") for _ in range(rng.randrange(1, 10))).encode()
        assert all_paths(data) == [automaton.path(data)]


def test_documents(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: want(library, r.text) for r in rows} and len(rows) == len(got)


def test_edges(spark, automaton, library):
    """Null and empty texts have no tokens; repeated rows and other columns stay as they are."""
    texts = [None, "", " \n", "one", "one", "x" * 70_000 + " é", "<|endoftext|>", "<|startoftext|><|endoftext|>a"]
    rows = spark.createDataFrame([(i // 2, t, "n", [7], "d") for i, t in enumerate(texts)], "doc_id long, text string, _text string, ids array<int>, decoded string").repartition(3)
    coded = bpe.decode(bpe.encode(rows, automaton), automaton)
    assert set(coded.columns) == set(rows.columns)
    got = sorted((r.doc_id, r.text or "", r._text, r.decoded, len(r.ids)) for r in coded.collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == sorted((i // 2, t or "", "n", library.decode(x, skip_special_tokens=False), len(x)) for i, (t, x) in enumerate(zip(texts, ids)))
    assert bpe.encode(rows.limit(0), automaton).count() == 0
    odd = spark.createDataFrame([(None,), ([-1, 320, 10**6],), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, automaton).collect()] == ["", " a</w> ", ""]
    named = bpe.encode(rows.select("doc_id", "text"), automaton, out="text").collect()
    assert sorted(len(r.text) for r in named) == sorted(map(len, ids))


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="isn't a vocabulary"):
        bpe.compile_automaton(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_worker_remembers_little():
    """Two workers' words and arcs must fit beside an executor's heap: at most 150,000 of each, and one text's."""
    import public_tokenizers

    automaton = bpe.compile_automaton(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(0, 240_000, 2000):
        automaton.encode(" ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(i, i + 2000)))
        assert len(automaton.words) <= 160_000 and len(automaton.arcs) <= 150_000


def test_one_step_of_workers(spark):
    """Encoding and decoding share the Python workers: two steps' workers took an executor past its memory."""
    plan = bpe.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_packed_and_decoded_beside_ids(spark, automaton):
    """The columns that encoding adds are those of the ids and of decode, and replace columns of their names."""
    texts = [None, "", "One two, three", "<|endoftext|>x", "\u00e9 \u0301"]
    rows = spark.createDataFrame([(i, t, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, packed int")
    got = bpe.decode(bpe.encode(rows, automaton, packed="packed", decoded="decoded"), automaton, out="again").orderBy("doc_id").collect()
    assert [r.text for r in got] == texts
    for r in got:
        assert bytes(r.packed) == np.array(r.ids, dtype="<u4").tobytes() and r.decoded == r.again
