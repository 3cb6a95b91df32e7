"""Substring dedup, the Merkle manifest and fill-in-the-middle against plain Python, with the usual edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import automata, fill_in_middle, merkle, substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{k}" for k in range(70))
COPY = " ".join(f"c{k % 41}" for k in range(300))
TEXTS = [
    (1, f"alpha {PASSAGE} omega"), (2, f"before\n{PASSAGE}\tafter it"), (3, PASSAGE.upper()), (4, None), (5, ""), (6, " \n "), (None, f"none {PASSAGE}"), (None, None), (7, COPY), (8, COPY), (8, COPY), (9, f"x {COPY}"),
    (10, " ".join(["same"] * 200)), (11, " ".join(["same"] * 60)), (12, " ".join(f"p{k}" for k in range(49))), (13, " ".join(f"p{k}" for k in range(50))), (14, PASSAGE + " " + PASSAGE), (15, "é😀 <P> a\nb\n"), (16, "\n\n\n"), (17, "no end of line"),
    (18, "<<S\nX><P\n>é\n" * 3), (-5, PASSAGE), (19, "z" * 20000 + "\n" + "y😀\n" * 5000), (20, "<M"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 4 == 3 else f"s{(i or 0) % 2}", len(t) if t else None, "mine") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, form string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def without_repeats(texts, length=50):
    least = {}
    for i, t in texts:
        w = W.findall(t or "")
        for k in range(len(w) - length + 1):
            if i is not None:
                least[key] = min(i, least.get(key := tuple(w[k : k + length]), i)) if (key := tuple(w[k : k + length])) else None
    out = []
    for i, t in texts:
        w = W.findall(t or "")
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and least[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("forced", [{}, {"PACK_BYTES": 1500, "BUCKET_WORDS": 40, "BROADCAST_BYTES": -1}])
def test_repeats_against_plain_python(docs, empty, monkeypatch, forced):
    for k, v in forced.items():
        monkeypatch.setattr(substring_dedup, k, v)
    got = substring_dedup.without_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == without_repeats(TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[1].spans[0].first == 1 and by[1].spans[0].upto == 71 and by[3].n_removed == 0
    assert all(sum(s.upto - s.first for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize(("length", "start"), [(50, 50), (7, 2), (1, 1), (64, 1)])
def test_repeats_at_other_lengths(spark, monkeypatch, length, start):
    monkeypatch.setattr(substring_dedup, "PACK_BYTES", 400)
    rng = random.Random(length)
    texts = [(k, " ".join(rng.choices("ab", k=rng.randrange(120)))) for k in range(40)] + [(50, "a " * 90), (51, "a " * 90)]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(4)
    got = substring_dedup.without_repeats(df, length=length, start=start)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == without_repeats(texts, length)


def test_levels_double():
    assert substring_dedup.lengths(50, 13) == [13, 25, 50] and substring_dedup.lengths(64, 1) == [1, 2, 4, 8, 16, 32, 64] and substring_dedup.lengths(5, 9) == [5]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root, and for each leaf its siblings by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, k in zip(ways, at, strict=True):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            way.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        nodes, at = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], ways


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        i, text = r[0], r[4]
        bad = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups.setdefault(r[1], []).append((i, digest(*map(part, r)), digest(*map(part, [*r[:4], bad]))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf for _, leaf, _ in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, leaf, bad), way in zip(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1], strict=True):
            fold = bad
            for a, b in [*way, *top]:
                fold = digest(a, fold, b)
            out.append((i, leaf, trees[s][0], root, digest(*[a + b for a, b in [*way, *top]]), fold))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_merkle_against_plain_python(spark, levels):
    rows = [(k, f"s{k % 3 if k % 2 else 0}", None if k % 5 == 0 else "en", k, f"text {k}\nmore") for k in range(100)]
    rows += [(None, "s1", "en", 1, "x\n"), (None, "s1", "en", 1, "x\n"), (7, "s1", "é", None, None), (8, "alone", "en", 3, ""), (9, None, "en", 3, "n\n"), (10, "", "en", 3, "n\n"), (11, "0", None, None, None), (5, "s2", "en", 1, "tie"), (5, "s2", "en", 2, "tie")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    whole = lambda text: merkle.hashed(*[merkle.part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.part(text))
    bad = whole(F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    got = merkle.merkle_manifest(df, whole(F.col("text")), "source", "doc_id", {"bad": bad}, levels).select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("way")).cast("binary"), 256), merkle.folded(F.col("bad"), F.col("way")), merkle.folded(F.col("leaf"), F.col("way")) == F.col("root"))
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[:6] for r in got] == manifest(rows) and all(r[6] for r in got)


def test_merkle_of_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, "s", "t", "mine")], "doc_id long, source string, text string, key string")
    leaf = merkle.hashed(merkle.part(F.col("text")))
    got = merkle.merkle_manifest(one, leaf, "source", "doc_id", {"key": F.col("key")}).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root == digest("1:t") and got[0].way == [] and got[0].key == "mine"
    assert merkle.merkle_manifest(one.limit(0), leaf, "source", "doc_id").count() == 0


def cut(i, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return i, len(units), "plain", None, None, text
    return (i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("forced", [{}, {"GIANT": 3, "BLOCK": 2, "GROUP": 3}, {"GIANT": 700, "BLOCK": 600, "GROUP": 2}])
def test_cuts_against_plain_python(docs, empty, monkeypatch, forced):
    for k, v in forced.items():
        monkeypatch.setattr(fill_in_middle, k, v)
    some = docs.filter("doc_id IS NULL OR doc_id <> 19") if forced.get("BLOCK") == 2 else docs
    got = fill_in_middle.fill_in_middle(some).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = got.collect()
    want = [cut(i, t) for i, t in TEXTS if some is docs or i != 19]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=str) == sorted(want, key=str)
    assert sorted((str(r.doc_id), r.back) for r in rows) == sorted((str(i), t or "") for i, t in TEXTS if some is docs or i != 19)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_shares_of_forms(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "'a\nb\nc' AS text")
    forms = {r.form: r["count"] for r in fill_in_middle.fill_in_middle(df, percent=50, spm_percent=25).groupBy("form").count().collect()}
    assert 150 < forms["plain"] < 250 and 25 < forms["spm"] < 85 and sum(forms.values()) == 400


def test_automata_compose():
    rng = random.Random(3)
    texts = ["".join(rng.choices("<PSM>\nx", k=rng.choice([0, 1, 511, 512, 513, 2000]))).encode() for _ in range(60)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for machine in (automata.lines(), automata.finder(("<P>", "<S>", "<M>", "P<S"))):
        found = automata.scan(machine, data, ends)
        for k, t in enumerate(texts):
            for entry in range(machine.states):
                state, n = entry, 0
                for b in t:
                    n += 0 if machine.begins is None else machine.begins[state, machine.classes[b]]
                    state = machine.moves[state, machine.classes[b]]
                exits, counts = found.whole(k)
                assert (exits[entry], counts[entry]) == (state, n)
        assert machine.begins is not None or [found.whole(k)[0][0] == machine.states - 1 for k in range(60)] == [any(x in t for x in (b"<P>", b"<S>", b"<M>", b"P<S")) for t in texts]
