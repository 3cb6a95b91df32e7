"""The corpus pipeline against the same stages in plain Python, over awkward rows."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_edges import BASE, SCHEMA, _disclosed, base_spans, components, words

from corpusloom.llm import pii, quality_rules, source_mixing


def judged(text):
    """Whether a text passes the rules of the pipeline's first stage."""
    t, w = text or "", words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    lines = [x for x in t.split("\n") if words(x)]
    stop = set(quality_rules.STOP_WORDS)
    f = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_repeat_words": len({k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}),
        "n_letter_words": sum(any(c.isalpha() for c in x) for x in w), "n_stop_words": len({x.lower() for x in w if x in stop or (x[0].isupper() and x == x.capitalize() and x.lower() in stop)}),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_bullet_lines": sum(x.lstrip(" \t\r\f\v")[:1] in ("-", "*", "•") for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(" \t\r\f\v").endswith(("...", "…")) for x in lines),
    }
    for r in quality_rules.THRESHOLDS:
        value, per = (f[r.feature], 1) if r.per is None else (100 * f[r.feature], f[r.per])
        if r.name != "too_long" and ((r.least is not None and value < per * r.least) or (r.most is not None and value > per * r.most)):
            return False
    return True


def masked(text, told):
    spans = [(a, k, b, f"[{kind.upper()}]") for k, (kind, _) in enumerate(BASE) for x, a, b in base_spans(text) if x == kind]
    for (a, b), removed in told.items():
        word = text[a:b]
        spans.append((a, 9, b, "" if removed else "[ACRONYM]" if word.isupper() else "[NAME]" if word[0].isupper() else "[WORD]"))
    out, at = "", 0
    for a, _, b, by in sorted(spans):
        if a >= at:
            out += text[at:a] + by
        at = max(at, b)
    return out + text[at:]


def dealt(children, share):
    """Shares of (key, weight, cap) in whole tokens."""
    if not any(w for _, w, _ in children):
        children = [(k, 1, c) for k, _, c in children]
    order = sorted(children, key=lambda x: (x[2] / x[1] if x[1] else float("inf"), x[0]))
    out, rest = {}, share
    while order and order[0][1] and rest * order[0][1] >= order[0][2] * sum(w for _, w, _ in order):
        k, _, c = order.pop(0)
        out[k], rest = c, rest - c
    total, upto = sum(w for _, w, _ in order), 0
    for k, w, _ in order:
        out[k] = rest * (upto + w) // total - rest * upto // total
        upto += w
    return out


def mixed(rows):
    """Rows (id, text, lang, source) that nine tenths of the tokens keep."""

    def leaf(r):
        number = re.search(r"([0-9]{1,9})$", r[3] or "")
        return (f"d{int(number.group(1)) % 4}" if number else "other", r[2], r[3])

    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += len(words(r[1]))
    share = {(): int(sum(tokens.values()) * 0.9)}
    for depth in (1, 2, 3):
        nodes = Counter()
        for k, n in tokens.items():
            nodes[k[:depth]] += n
        nexts = {}
        for parent, s in share.items():
            nexts |= dealt([(k, source_mixing.WEIGHTS.get(k, 1), n) for k, n in nodes.items() if k[:-1] == parent], s)
        share = nexts
    out = []
    for k, target in share.items():
        own = [r for r in rows if leaf(r) == k]
        epochs, rest = divmod(target, tokens[k]) if tokens[k] else (0, 0)
        place = lambda r: hashlib.md5(f"{source_mixing.SEED}-{epochs}-{'' if r[0] is None else r[0]}".encode()).hexdigest() + f"{len(words(r[1])):020d}"  # noqa: B023, E731
        upto = 0
        for r in sorted(own, key=place):
            n = len(words(r[1]))
            if epochs or (n and upto < rest):
                out.append(r)
            upto += n
    return out


def prose(rng, n, language="en"):
    stop = {"en": "the of and to in is", "de": "der die und das ist von"}[language].split()
    names = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "su") for b in ("dan", "fir", "mos", "tel") for c in ("a", "en", "o")]
    return " ".join(rng.choice(stop if rng.random() < 0.4 else names) for _ in range(n))


def rows_of_all_kinds():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(55, 140), "de" if i % 4 == 0 else "en"), "de" if i % 4 == 0 else "en", f"src{i % 7}"))
    rows[3] = (3, rows[3][1] + " Zorbax writes from ann.lee@mail.example.org", "en", "src3")
    rows[5] = (5, "Zorbax " + rows[5][1] + " ann.lee@mail.example.org and 10.0.0.1", "en", "src5")
    for k in (1, 3, 6, 9):  # near copies, with one word of many changed
        changed = rows[k][1].split(" ")
        changed[len(changed) // 2] = "other"
        rows.append((70 + k, " ".join(changed), rows[k][2], rows[k][3]))
    rows += [(80 + k, rows[2][1], "en", "src0") for k in range(6)] + [rows[2], rows[2]]  # copies, and rows repeated
    rows += [(100, None, "en", "src1"), (101, "", None, None), (102, " \n ", "en", "src1"), (103, "short text", "en", None), (104, "# " * 200, "en", "src1"), (105, "same line of the text and\n" * 40, "en", "src2")]
    rows += [(106, prose(rng, 4000), "en", None), (107, prose(rng, 80), None, "wiki"), (108, "x" * 20000 + " " + prose(rng, 5000), "en", "src3")]
    return rows


def test_stages_against_plain_python(spark):
    import sentencepiece

    import corpus_pipeline
    from corpusloom.llm import sentencepieces

    rows = rows_of_all_kinds()
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "kept", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens int").repartition(4)

    def same(df, want):
        assert df.columns == docs.columns and df.filter("kept <> 'kept' OR n_tokens <> 7").count() == 0
        got = sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)
        assert got == sorted(((*r, len(r[1])) for r in want), key=str)

    stages = [f for _, f in corpus_pipeline.STAGES]
    want = [r for r in rows if judged(r[1])]
    assert len(want) < len(rows) - 4
    out = corpus_pipeline.stored(stages[0](spark, docs, ""), "test")
    same(out, want)

    roots = {(i, c) for i, _, c in components([r[:2] for r in want], 5, 80)}
    want = [r for r in dict.fromkeys(want) if (r[0], r[0]) in roots]
    assert {71, 79, 80, 85}.isdisjoint(r[0] for r in want) and {1, 2, 9}.issubset(r[0] for r in want)
    out = corpus_pipeline.stored(stages[1](spark, out, ""), "test")
    same(out, want)

    told = _disclosed([r[:2] for r in want], pii.MIN_SUPPORT)
    want = [(i, masked(t, x), *rest) for (i, t, *rest), x in zip(want, told, strict=True)]
    assert any("[EMAIL]" in r[1] and "Zorbax" not in r[1] for r in want)
    out = corpus_pipeline.stored(stages[2](spark, out, ""), "test")
    same(out, want)

    before, want = want, mixed(want)
    assert 0 < len(want) < len(before)
    out = corpus_pipeline.stored(stages[3](spark, out, ""), "test")
    same(out, want)

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    got = sorted((r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in stages[4](spark, out, "").collect())
    assert got == sorted((i, len(ids := lib.encode(t)), ids, hashlib.sha256(lib.decode(ids).encode()).hexdigest()) for i, t, *_ in want)


def test_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], f"{SCHEMA}, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), "test")
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").withColumn("x", F.lit(1)).count() == 0


def test_encoding_tells_the_span_of_each_piece(spark):
    import sentencepiece

    import corpus_pipeline
    from corpusloom.llm import sentencepieces

    texts = ["Hello world,  two blanks\n\tand lines", "naïve café 日本語 😀 x", "▁ own marks ▁▁ here", "", None]
    docs = spark.createDataFrame([(k, t, "en", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    for r in corpus_pipeline.encoding(spark, docs, "").collect():
        text = texts[r["doc_id"]] or ""
        data, pieces = text.encode(), lib.encode(text, return_type="proto").pieces
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"]) == len(pieces)
        covered = set()
        for p, i, a, b in zip(pieces, r["ids"], r["begins"], r["ends"], strict=True):
            covered.update(range(a, b))
            assert p.id == i and (lib.is_byte(i) or data[a:b].decode() == p.surface)
        assert covered == set(range(len(data)))
