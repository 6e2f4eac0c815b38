"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm import bpe, chat, exact_dedup, lengths, licences, mixing, near_dedup, quality, transport, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi nu pe ra so ti".split() for b in "ba de fi go hu".split()]


def docs(spark, rows):
    """Documents of (doc_id, text), with an extra column whose name clashes with an internal one."""
    full = [(i, t, "en" if i is None or i % 3 else None, f"s{(i or 0) % 2}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOC).withColumn("rep", F.lit("clash")).withColumn("recipe", F.lit(1)).withColumn("kept", F.lit(False))


EDGE = [(1, ""), (2, None), (None, "alone here"), (3, "one"), (4, "ONE"), (4, "ONE"), (5, "x " * 30_000), (6, "a b c\x0bd ퟿ \U0001f600 ☃"), (7, "a b c\x0bd ퟿ \U0001f600 ☃"), (None, "one")]


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows, k, percent=80):
    sets = {i: sets_of(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    r = random.Random(k)
    base = [r.choices(WORDS, k=r.randint(3, 120)) for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    hot = r.choices(WORDS, k=150)
    for _ in range(60):  # a group larger than a small bucket, some of it at the threshold
        w = list(hot)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((len(rows), " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == near_brute(rows, k)


def test_near_duplicates_edges(spark):
    got = [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(docs(spark, EDGE), k=4).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 1, None, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True), (6, len(sets_of(EDGE[7][1], 4)), 6, True), (7, len(sets_of(EDGE[7][1], 4)), 6, False), (None, 1, 3, False)], key=repr)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_exact_duplicates_edges_and_clashing_identifiers(spark):
    weak = lambda c: F.length(c).cast("string")
    r = random.Random(1)
    rows = EDGE + [(100 + i, " ".join(r.choices(WORDS, k=r.choice([5, 400, 900]))) + ".") for i in range(20)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[-5:])]
    top: dict = {}
    n = Counter(t or "" for _, t in rows)
    for i, t in rows:
        top[t or ""] = max([x for x in (top.get(t or ""), i) if x is not None], default=None)
    want = sorted(((i, top[t or ""], n[t or ""], i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    for identify in (exact_dedup.digest, weak):
        got = exact_dedup.exact_duplicates(docs(spark, rows), identify=identify).collect()
        assert sorted((tuple(x) for x in got), key=repr) == want
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_keep_one_leaves_one_row_of_equals(spark):
    rows = [(4, "ONE"), (4, "ONE"), (5, "ONE"), (4, "three"), (9, "dup"), (9, "dup"), (9, "other"), (None, "x"), (None, "x"), (None, None), (None, ""), (1, "")]
    for f in (exact_dedup.keep_one, lambda d: exact_dedup.keep_one(d.repartition(7))):
        got = sorted(((x["doc_id"], x["text"]) for x in f(docs(spark, rows)).collect()), key=repr)
        assert got == sorted([(5, "ONE"), (4, "three"), (9, "dup"), (9, "other"), (None, "x"), (1, "")], key=repr)
    got = sorted(((x["doc_id"], x["text"]) for x in near_dedup.keep_one(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(4, "ONE"), (4, "three"), (9, "dup"), (9, "other"), (None, "x"), (None, ""), (1, "")], key=repr)
    told = spark.createDataFrame([(1, "t", "b"), (1, "t", "a"), (1, None, "b"), (1, "", "c")], "doc_id long, text string, source string")
    for f in (exact_dedup.keep_one, near_dedup.keep_one):
        assert sorted(map(tuple, f(told).collect()), key=repr) == [(1, "", "c"), (1, "t", "a")] and f(told).columns == told.columns
        assert f(told.limit(0)).count() == 0


def test_blocks_of_a_bucket_are_dealt_out(spark):
    """All rows in one bucket: the blocks are tasks of their own, and every pair of a row with an asking row outside the main component meets in one block."""
    rows = spark.range(600).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("component"), F.lit(5).alias("n"), F.array(F.lit(1)).alias("sketch"))
    pieces = spark.createDataFrame([(1, 0, 6, 4)], "key long, main long, p int, q int")
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            blocks = near_dedup._in_blocks(rows, pieces, [])
            grouped = blocks.groupBy("key", "i", "j").applyInArrow(lambda t: t.select(["key"]), "key int")
            plan = grouped._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(key#" in plan and all(f", {c}#" in plan.split("hashpartitioning(key#")[1].split(")")[0] for c in "ij"), plan
            table = blocks.toPandas()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        held, asks = table[~table.asks], table[table.asks]
        assert len(table.groupby(["i", "j"])) == 24 and table.groupby(["i", "j"]).size().max() < 600 / 6 + 200 / 4 + 60
        met = asks.merge(held, on=["i", "j"])[["rep_x", "rep_y"]].drop_duplicates()
        assert len(met) == 200 * 600


def test_links_at_the_threshold_are_found(spark):
    """Pairs of a similarity from 0.80 to 0.82, which bands and sketches may miss by chance."""
    r = random.Random(14)
    rows, want = [], set()
    while len(want) < 400:
        w = [f"{r.randrange(10**9)}" for _ in range(r.choice([60, 120, 300]))]
        v = list(w)
        for k in r.sample(range(len(v)), max(1, round(len(v) * 0.023))):
            v[k] = "other"
        a, b = sets_of(" ".join(w), 5), sets_of(" ".join(v), 5)
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            i = len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
            want.add((i, i + 1))
    got = {(x["component_id"], x["doc_id"]) for x in near_dedup.near_duplicates(docs(spark, rows)).where("not kept").collect()}
    assert got == want


def test_chunks_put_together_are_the_text(spark):
    r = random.Random(2)
    texts = ["", "x", "no marks " * 3000, "A b. " * 2000, "".join(r.choice("ab. \n!é😀") for _ in range(20_000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(F.concat_ws("", exact_dedup.cut(F.col("text"))) != F.col("text")).count() == 0


def test_mixing_meets_marginals(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 900))) + r.choice(["", " | ", "###", " License"])) for i in range(400)] + EDGE
    mixed = mixing.mix(docs(spark, rows)).toPandas()
    assert len(mixed) == len(rows)
    for m in ("source", "lang", "topic"):
        w = mixed.groupby(m).n_tokens.sum()
        s = (w / w.sum()) ** mixing.ALPHA
        s = s[w > 0] / s[w > 0].sum()
        got = (mixed.n_tokens * mixed.probability * mixed.weight).groupby(mixed[m]).sum()
        assert max(abs(got[w > 0] / got.sum() - s)) < 0.01
    assert mixed.probability.between(0, 1).all() and (mixed.weight >= 1).all() and mixed.sampled.mean() > 0.5
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_stage_meets_targets(spark):
    """The rows that the stage puts out have the target shares: cells below theirs grow."""
    import corpus_pipeline

    size = {"large": 2000, **{f"s{k}": 400 for k in range(10)}, "rare": 20}
    rows = [(n, f"word {n} of a text", "en", s) for n, s in enumerate(s for s, k in size.items() for _ in range(k))]
    rows += [(None, "one without an id", "en", "large"), (-1, "", "xx", "empty"), (-2, None, "xx", "empty")]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("clash"))
    out = corpus_pipeline.mixing_stage(spark, given, "")
    assert out.columns == given.columns and out.exceptAll(out.intersect(given)).distinct().exceptAll(given).count() == 0
    got = Counter((x["doc_id"], x["source"]) for x in out.where("text <> ''").collect())
    tempered = {s: k**mixing.ALPHA for s, k in size.items()}
    want = {s: t / sum(tempered.values()) for s, t in tempered.items()}
    have = Counter()
    for (_, s), k in got.items():
        have[s] += k
    assert max(abs(have[s] / sum(have.values()) - want[s]) for s in size) < 0.01
    for s in size:
        f = want[s] * sum(size.values()) / size[s]
        assert {got[i, s] for i, _, _, x in rows if x == s and i is not None} <= {int(f * 0.99), int(f), int(f) + 1}, s
    assert got[0, "large"] <= 1 < min(got[i, "rare"] for i in range(6000, 6020))
    assert out.where("text is null or text = ''").count() <= 2 and corpus_pipeline.mixing_stage(spark, given.limit(0), "").count() == 0


def test_quality_learns_and_leaves_held_out_labels_alone(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = r.choices(WORDS, k=r.randint(20, 80))
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w)))
        labels.append((i, int(good)))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.score(docs(spark, rows + EDGE[:4]), lab).collect()
    truth = dict(labels)
    held = [x for x in out if x["held_out"]]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out)
    assert sum((x["score"] >= 0.7) == bool(truth[x["doc_id"]]) for x in held if x["doc_id"] in truth) >= 0.97 * len(held)
    # Held-out labels turned round change no score.
    turned = spark.createDataFrame([(i, 1 - y if quality.held_out(i) else y) for i, y in labels], "doc_id long, quality int")
    again = {x["doc_id"]: x["score"] for x in quality.score(docs(spark, rows), turned).collect()}
    first = {x["doc_id"]: x["score"] for x in quality.score(docs(spark, rows), lab).collect()}
    assert again == first
    assert quality.score(docs(spark, []), lab).count() == 0
    assert {x["score"] for x in quality.score(docs(spark, EDGE), lab.limit(0)).collect()} == {0.5}


def test_quality_vectors_and_pooling_equal_a_plain_twin(spark):
    np = pytest.importorskip("numpy")
    r = random.Random(18)
    parts = ["the", "The", "THE", "ABc", "x1", "12", "##", "ok.", "Zug", "é", "a-b", "  ", "\t"]
    texts = ["", "one", "One"] + [" ".join(r.choices(parts + WORDS, k=r.randint(0, 60))) for _ in range(60)]
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 2 if chr(b).isascii() and chr(b).isupper() else 4 if chr(b) in "0123456789" else 1 if b >= 128 or chr(b).islower() else 3

    def words(text):
        b, out, at = text.encode(), [], 0
        while at < len(b):
            end = at + 1
            while end < len(b) and (kind(b[end]) == kind(b[end - 1]) or (kind(b[end]) == 1 and kind(b[end - 1]) == 2 and (end < 2 or kind(b[end - 2]) != 2))):
                end += 1
            if kind(b[at]):
                out.append((b[at:end], kind(b[at])))
            at = end
        raw = [int(quality.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] % np.uint64(quality.BUCKETS - 8)) for w, _ in out]
        return [quality.BUCKETS - 8 + out[i][1] if x in raw[max(0, i - 2) : i] else x for i, x in enumerate(raw)]

    index = quality.index_vectors().astype(np.int64)
    total = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for t in texts:
        w = words(t)
        for i, x in enumerate(w):
            for k in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if k != i:
                    total[x] += index[w[k]]
    total -= np.outer(np.abs(total).sum(axis=1), total.sum(axis=0) / np.abs(total).sum())
    unit = total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True))
    got = quality.word_vectors(docs(spark, list(enumerate(texts))).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert np.allclose(got, unit, atol=1e-5)
    for t, x in zip(texts, quality.pool([t.encode() for t in texts], got), strict=True):
        w = words(t)
        assert np.allclose(x[:-1], np.mean([unit[k] for k in w], axis=0) if w else 0, atol=1e-5) and abs(x[-1] - math.log1p(len(w))) < 1e-9


def test_licences_equal_brute_force(spark):
    r = random.Random(5)
    lines = [t for _, t in licences.TEMPLATES] + ["the work is under a license", "nothing here", "", "Licensed under the Apache licence 2.0"]
    files = []
    for i in range(80):
        folder = "/".join(r.choices(["a", "b", "c"], k=r.randint(0, 3)))
        name = r.choice(["LICENSE", "COPYING.txt", "x.py"]) + str(i)
        files.append((i, f"{folder}/{name}" if folder else name, "\n".join(r.choices(lines, weights=[1] * 7 + [2, 8, 8, 2], k=4))))
    files += [(None, None, None), (80, "a/b/c/y.py", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("folder", F.lit(1))
    got = {(x["doc_id"], x["path"]): (x["own_license"], round(x["similarity"], 6), x["license"], x["inherited_from"]) for x in licences.scan(df).collect()}
    vocab = {t for _, text in licences.TEMPLATES for t in licences.terms(text)}
    n = len(files)
    df_ = Counter(t for _, _, text in files for t in vocab & set(licences.terms(text or "")))
    idf = lambda t: math.log((1 + n) / (1 + df_[t])) + 1 if t in vocab else math.log((1 + n) / 2) + 1
    vec = lambda text: {t: c * idf(t) for t, c in Counter(licences.terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def own(text):
        best = (0.0, None)
        for i, (name, tpl) in enumerate(licences.TEMPLATES):
            for line in (text or "").split("\n"):
                a, b = vec(line), vec(tpl)
                c = round(sum(x * b.get(t, 0) for t, x in a.items()) / (norm(a) * norm(b)), 9) if a else 0
                if c >= licences.THRESHOLD and c > best[0]:
                    best = (c, name)
        return best

    dirs: dict = {}
    for _, path, text in files:
        path = path or ""
        folder, _, name = path.rpartition("/")
        c, lic = own(text)
        if lic and name.lower().startswith(("license", "licence", "copying", "notice")):
            dirs.setdefault(folder, []).append((-c, path, lic))
    for i, path, text in files:
        path = path or ""
        c, lic = own(text)
        at, inherited, final = path.rpartition("/")[0], None, lic
        while lic is None:
            if at in dirs:
                inherited, final = at, min(dirs[at])[2]
                break
            if not at:
                break
            at = at.rpartition("/")[0]
        assert got[(i, path)] == (lic, round(c, 6), final, inherited)
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_of_real_files(spark):
    notice = dict((n, t) for n, t in licences.NOTICES)
    first = lambda name, word: next(t for n, t in licences.NOTICES if n == name and word in t)
    comment = lambda text, mark: "\n".join(f"{mark} {line}" for line in text.split("\n"))
    apache, gpl = first("Apache-2.0", "compliance"), first("GPL-3.0", "redistribute")
    files = [
        ("a/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + "words of the terms " * 300, "Apache-2.0"),
        ("b/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + "preamble " * 300, "GPL-3.0"),
        ("c/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + notice["MIT"].replace("\n", " "), "MIT"),
        ("d/LICENSE.txt", "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + notice["BSD-3-Clause"], "BSD-3-Clause"),
        ("e/LICENSE", "Copyright (c) 2020 Some Body\n\n" + notice["ISC"], "ISC"),
        ("f/x.py", "# Copyright 2020 Some Body\n#\n" + comment(apache, "#") + "\n\nimport os\n", "Apache-2.0"),
        ("f/x.c", "/*\n" + comment(gpl, " *") + "\n */\nint main() { return 0; }\n", "GPL-3.0"),
        ("f/y.rs", "// Copyright 2020 Some Body\n// SPDX-License-Identifier: MIT\nfn main() {}\n", "MIT"),
        ("f/z.js", "// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"),
        ("f/m.cpp", comment(first("MPL-2.0", "Form"), "//") + "\nvoid f();\n", "MPL-2.0"),
        ("f/n.py", "def f(software, copyright, notice):\n    return 'the license of the software'\n", None),
        ("c/src/deep/g.py", "print('ok')\n", "MIT"),
    ] + [(f"prose/p{k}", f"Nothing of the kind is said here, in text number {k}.\nIt is of the usual sort.\n", None) for k in range(40)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {x["path"]: x for x in licences.scan(df).collect()}
    assert {p: got[p]["license"] for p, _, _ in files} == {p: w for p, _, w in files}
    assert got["c/src/deep/g.py"]["inherited_from"] == "c" and got["f/x.py"]["matched"] == "block" and got["f/y.rs"]["line"] == 1
    # A scanner passes by only what is below the threshold.
    own = licences.Scanner({"license": 30, "the": 40}, 52, licences.NOTICES)
    r = random.Random(15)
    for _ in range(300):
        words = [w for _, t in r.sample(licences.NOTICES, 2) for w in licences.terms(t) if r.random() < 0.7] + r.choices(["other", "words"], k=r.randint(0, 9))
        vec = {t: n * own.idf.get(t, own.other) for t, n in Counter(words).items()}
        cosines = []
        for _, text in licences.NOTICES:
            w = {t: n * own.idf[t] for t, n in Counter(licences.terms(text)).items()}
            cosines.append(sum(x * w.get(t, 0) for t, x in vec.items()) / math.sqrt(sum(x * x for x in vec.values()) * sum(x * x for x in w.values())) if vec else 0)
        cosine, i = own.best(words)
        assert (cosine == pytest.approx(max(cosines), abs=1e-8) and cosines[i] == pytest.approx(max(cosines), abs=1e-8)) if max(cosines) > 0.6 + 1e-8 else i == -1 or max(cosines) > 0.6 - 1e-8


MESSAGE = "conv_id long, node_id long, parent_id long, role string, text string, score double"


def test_best_branch_of_reply_trees(spark):
    r = random.Random(6)
    rows, want = [], {}
    for conv in range(12):
        n = r.randint(1, 40)
        parent = {k: (None if k == 0 else r.randrange(max(0, k - 4), k)) for k in range(n)}
        score = {k: float(r.randint(0, 9)) for k in range(n)}
        rows += [(conv, k, parent[k], "assistant" if k % 2 else "user", f"t{conv}.{k} <|im_end|>\\", score[k]) for k in range(n)]
        paths = []
        for leaf in set(parent) - {p for p in parent.values() if p is not None}:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[k] for k in path), -len(path), leaf, path[::-1]))
        want[conv] = min(paths)[3]
    rows += [(50, 0, 1, "user", "circle", 1.0), (50, 1, 0, "user", "circle", 1.0), (51, 7, 99, None, None, None), (52, 3, 3, "user", "own", None)]
    df = spark.createDataFrame(rows, MESSAGE)
    got: dict = {}
    for x in chat.best_paths(df).orderBy("conv_id", "pos").collect():
        got.setdefault(x["conv_id"], []).append(x["node_id"])
    assert got == want | {51: [7], 52: [3]}
    text = {(a, b): (c or "", d or "") for a, b, _, c, d, _ in rows}
    for x in chat.read_back(chat.format_paths(df)).collect():
        turns = [(t["role"], t["text"]) for t in x["turns"]]
        assert turns == [text[(x["conv_id"], k)] for k in got[x["conv_id"]]]
        assert x["learned"] == "".join(t for role, t in turns if role == "assistant")
    assert chat.format_paths(df.limit(0)).count() == 0


def test_chat_escapes_reversibly_and_hides_control_strings(spark):
    r = random.Random(7)
    parts = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\|", "<|>", "|>", "\n", "ok", "é😀", "$1"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(x["t"] == x["u"] for x in rows)
    assert not any(c in x["e"] for x in rows for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))
    conv = spark.createDataFrame([(1, 0, "us er\n", "a"), (1, 0, "assistant", None), (1, None, None, "first"), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_paths(chat.chains(conv))).collect()
    assert [[(t["role"], t["text"]) for t in x["turns"]] for x in got] == [[("", "first"), ("assistant", ""), ("us er\n", "a")]]


def test_length_histogram_equals_brute_force(spark):
    r = random.Random(8)
    n = [r.choice([0, 1, 5, 511, 512, 513, r.randint(0, 3000)]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")
    table = lengths.histogram(df)
    for x in table.collect():
        k = x["context_limit"]
        assert x["documents"] == n.count(k)
        assert x["documents_within"] == sum(v <= k for v in n) and x["documents_beyond"] == sum(v > k for v in n)
        assert x["tokens_within"] == sum(v for v in n if v <= k) and x["tokens_truncated"] == sum(min(v, k) for v in n) and x["tokens_total"] == sum(n)
    assert lengths.truncated_total(table, 700) == sum(min(v, 700) for v in n)
    assert lengths.quantile(table, 0.5) == sorted(n)[math.ceil(0.5 * len(n)) - 1]
    assert lengths.histogram(df.limit(0)).count() == 0
    got = {x["doc_id"]: x["n_tokens"] for x in lengths.encoded_lengths(docs(spark, EDGE)).collect()}
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(got[i] == len(t.encode(x or "", add_special_tokens=False).ids) for i, x in EDGE if i is not None)


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.word_file())
    r = random.Random(9)
    texts = ["a" * k for k in range(1, 80)] + ["".join(r.choice("the quick'sre12 !?.ÉßΣς́\t\x1c\x85é😀") for _ in range(r.randint(0, 90))) for _ in range(400)]
    texts += ["x<|endoftext|>y <|startoftext|>", "ΑΣ İ ǅ", "I'll they've 12345", "<|endoftext|"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, None)]
    out = {x["doc_id"]: x for x in bpe.encode_decode(docs(spark, rows), keep=True).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert out[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode_decode(docs(spark, [])).count() == 0


def test_bpe_of_words_that_share_long_beginnings_and_of_endless_words():
    """Against the library; and the walk's steps are no more than the bytes that no word shares with the one before."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    with open(bpe.word_file(), encoding="utf-8") as f:
        model = bpe.WordBPE(f.read())
    r = random.Random(13)
    stem = "".join(r.choice("abcdefgh") for _ in range(bpe.WIDTH))
    words = [stem[:n] + e for n in (0, 1, 5, bpe.WIDTH - 1, bpe.WIDTH) for e in ("a", "b", "abc", "abcabc" * 9, "abcabc" * 9 + "d", "é", "èé")] + ["\x00", "\x00\x00", "a\x00"]
    for w in words:
        got = model.encode([w, w + " " + w])
        for text, ids in zip((w, w + " " + w), got, strict=True):
            assert struct.unpack(f"<{len(ids) // 4}I", ids) == tuple(t.encode(text, add_special_tokens=False).ids), text
    together = model.encode([" ".join(words)])[0]
    assert together == b"".join(model.encode(words))
    held = list(bpe.trie(set(words)))
    assert [w for w, _, _ in held] == sorted(set(words))
    for (_, a, _), (_, b, n) in zip(held, held[1:], strict=False):
        assert n == len(next(x for x in (b[:k] for k in range(len(b), -1, -1)) if a.startswith(x)))
    steps = []
    last = model._last
    model._last = lambda ends, tokens: steps.append(len(ends)) or last(ends, tokens)
    long = "".join(r.choice("abcdefgh") for _ in range(300_000))
    ids = model.encode([long])[0]
    assert len(steps) == len(long) and max(steps) <= 32  # one step a letter, each over tokens that end there alone
    assert model.decode(ids).replace(" ", "") == long + "</w>"


def test_transport_streams_round_trip(spark):
    r = random.Random(10)
    for n in [0, 1, 576, 577, 9216, 9217, 9216 * 8, 9216 * 8 + 1, 200_000]:
        payload = transport.pad(r.randbytes(n))
        s = transport.unpack(transport.pack(payload))
        assert s.payload == payload and s.discontinuities == 0
        assert s.times.tolist() == [k * transport.TICKS for k in range(len(s.times))] and len(s.random_access) == -(-len(s.times) // 8)
    media = bytearray(transport.pack(transport.pad(b"x" * 30_000)))
    del media[188 * 20 : 188 * 21]
    with pytest.raises(ValueError):
        transport.unpack(bytes(media))
    media_table = transport.write_streams(docs(spark, EDGE + [(60, "y" * 100_000)]))
    long = media_table.where("doc_id = 60").first()
    assert long["times"] == [k * transport.TICKS for k in range(11)] and long["random_access"] == [0, 8 * transport.TICKS]
    with pytest.raises(Exception, match="index"):
        transport.read_streams(media_table.withColumn("times", F.reverse("times"))).collect()
    assert transport.read_streams(transport.write_streams(docs(spark, []))).count() == 0
    rows = transport.read_streams(media_table.where("doc_id is null or doc_id <> 60")).collect()
    for x, (i, t) in zip(sorted(rows, key=lambda x: (x["doc_id"] or 0, x["n_bytes"])), sorted(EDGE, key=lambda e: (e[0] or 0, len((e[1] or "").encode()))), strict=True):
        p = transport.pad((t or "").encode())
        assert (x["doc_id"], x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def plain_stream(stream):
    """Program, media PID, kind, payload, times and random-access times of a transport stream, read byte by byte as the standard lays it out."""
    program = map_pid = media = kind = None
    counters, pes, points = {}, [], []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, start, control, counter = (p[1] & 0x1F) * 256 + p[2], p[1] & 0x40, p[3] >> 4 & 3, p[3] & 15
        assert pid not in counters or counter == (counters[pid] + 1) % 16
        counters[pid] = counter
        body, random_access = 4, False
        if control & 2:
            random_access = p[4] > 0 and bool(p[5] & 0x40)
            body = 5 + p[4]
        data = p[body:]
        if pid == 0 and start:
            table = data[1 + data[0] :]
            assert table[0] == 0
            program, map_pid = table[8] * 256 + table[9], (table[10] & 0x1F) * 256 + table[11]
        elif pid == map_pid and start:
            table = data[1 + data[0] :]
            assert table[0] == 2
            first = 12 + (table[10] & 15) * 256 + table[11]
            kind, media = table[first], (table[first + 1] & 0x1F) * 256 + table[first + 2]
        elif pid == media:
            if start:
                pes.append(b"")
                points.append(random_access)
            pes[-1] += data
    payload, times = b"", []
    for x in pes:
        assert x[:3] == b"\0\0\1" and x[4] * 256 + x[5] + 6 == len(x)
        assert x[7] & 0x80 and x[9] >> 4 in (2, 3)
        times.append((x[9] >> 1 & 7) << 30 | x[10] << 22 | x[11] >> 1 << 15 | x[12] << 7 | x[13] >> 1)
        payload += x[9 + x[8] :]
    return program, media, kind, payload, times, [t for t, r in zip(times, points, strict=True) if r]


def test_transport_streams_against_a_plain_reader(spark):
    rows = [*EDGE, (61, "z" * 200_000), (62, "é☃" * 7_000)]
    media = transport.write_streams(docs(spark, rows))
    read = {(x["doc_id"], x["n_bytes"]): x for x in transport.read_streams(media).collect()}
    assert media.count() == len(rows)
    texts = {((i, len((t or "").encode()))): (t or "").encode() for i, t in rows}
    for x in media.collect():
        program, pid, kind, payload, times, points = plain_stream(bytes(x["media"]))
        own = read[x["doc_id"], x["n_bytes"]]
        assert payload[: x["n_bytes"]].lower() == texts[x["doc_id"], x["n_bytes"]].lower() and set(payload[x["n_bytes"] :]) <= {255}
        assert own["payload_bytes"] == len(payload) > 0 and len(payload) % 576 == 0 and own["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (own["times"], own["random_access"]) == (times, points) == (x["times"], x["random_access"])
        assert own["feature"].startswith(f"program={program};pid={pid};type={kind};") and f";pes={len(times)};" in own["feature"]


def test_warc_round_trip_of_awkward_payloads(spark):
    r = random.Random(11)
    v = "WARC/1.1\r\n"
    pages = [(1, "http://a/\r\nX: y", "h" * 300), (2, None, "h" * 300), (3, "u", v), (4, "u", "\r\n\r\n" + v + v + "\r\n"), (5, "u", ""), (6, "u", None), (7, "u", "s"), (8, "u", "s"), (9, "u", "x\r\n" * 60_000), (10, "u", ("é" * 70 + v) * 40), (12, "u", "W" * 199 + v + "\n"), (None, "u", "n" * 200), (13, "u", "n" * 200), (14, "u", "n" * 200), (15, "u", "﻿" + "".join(r.choice("\r\nWARC/1. é") for _ in range(5000)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    first: dict = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for chunk in (200, warc.CHUNK):
        got = {x["page_id"]: tuple(x)[1:] for x in warc.archive(df, chunk=chunk).collect()}
        for i, _, h in pages:
            b = (h or "").encode()
            again = i is not None and len(b) >= 100 and first[h or ""] != i
            assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None), (i, chunk)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_headers_keep_the_standard(spark, tmp_path):
    pages = [(1, "u", "h" * 300), (2, "u", "h" * 300), (3, "u", "x" * 1000), (4, "u", "short"), (5, "u", "r" * 150), (5, "u", "r" * 150), (6, "u", "r" * 150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for k in (0, 1):
        warc.write_archives(df, f"{tmp_path}/{k}", chunk=400)
    read = lambda k: sorted(r for f in sorted((tmp_path / str(k)).glob("part-*")) for r in f.read_bytes().split(warc.VERSION) if r)
    records = [dict(line.split(": ", 1) for line in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")) | {"block": int(len(r.partition(b"\r\n\r\n")[2]))} for r in read(0)]
    assert read(0) == read(1)  # identifiers too: a task that runs again writes the same
    by = {}
    for f in records:
        by.setdefault(f["X-Page-Id"], []).append(f)
    assert len({f["WARC-Record-ID"] for f in records}) == len(records)
    assert all("WARC-Segment-Number" not in f and "WARC-Segment-Total-Length" not in f for p in ("1", "2", "4", "5", "6") for f in by[p])
    parts = sorted(by["3"], key=lambda f: int(f["WARC-Segment-Number"]))
    assert [f["WARC-Type"] for f in parts] == ["response", "continuation", "continuation"] and ["WARC-Segment-Total-Length" in f for f in parts] == [False, False, True]
    assert int(parts[2]["WARC-Segment-Total-Length"]) == sum(int(f["Content-Length"]) for f in parts) == 1000 + len(warc.HTTP)
    assert {f["WARC-Segment-Origin-ID"] for f in parts[1:]} == {parts[0]["WARC-Record-ID"]}
    assert by["2"][0]["WARC-Type"] == "revisit" and by["2"][0]["WARC-Refers-To"] == by["1"][0]["WARC-Record-ID"]
    assert [f["WARC-Type"] for f in by["5"]] == ["response"] * 2 and "WARC-Refers-To" not in by["6"][0] and by["6"][0]["X-Refers-To-Page"] == "5"


def test_mixing_to_given_targets(spark):
    r = random.Random(16)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(100, 900))) + r.choice(["", " | "])) for i in range(400)]
    given = docs(spark, rows)
    targets = spark.createDataFrame([("source", "s0", 3.0), ("source", "s1", 1.0), ("topic", "table", 1.0), ("topic", "none there", 1.0), ("lang", "", None)], "margin string, value string, weight double")
    mixed = mixing.mix(given, targets=targets).toPandas()
    w = mixed.n_tokens * mixed.probability * mixed.weight
    assert abs(w[mixed.source == "s0"].sum() / w.sum() - 0.75) < 1e-6
    own = mixed.n_tokens[mixed.topic == "table"].sum() / mixed.n_tokens.sum()
    assert abs(w[mixed.topic == "table"].sum() / w.sum() - own) < 1e-6  # named alone, it shares with none
    report = {(x["margin"], x["value"]): x for x in mixing.fit(given, targets=targets).collect()}
    assert report["source", "s0"]["met"] and report["source", "s0"]["reached"] == pytest.approx(0.75 * mixed.n_tokens.sum(), rel=1e-6)
    assert not report["topic", "none there"]["met"] and report["topic", "none there"]["goal"] is None
    # One source in one language alone: the two marginals cannot be met together, and the report says so.
    apart = given.withColumn("lang", F.when(F.col("source") == "s0", "aa").otherwise("bb"))
    both = spark.createDataFrame([("source", "s0", 3.0), ("source", "s1", 1.0), ("lang", "aa", 1.0), ("lang", "bb", 3.0)], "margin string, value string, weight double")
    assert not all(x["met"] for x in mixing.fit(apart, targets=both).collect())
    looks = []
    seen = mixing.residual
    mixing.residual = lambda cells, margins=mixing.MARGINS: looks.append(seen(cells, margins)) or looks[-1]
    try:
        mixing.fit(apart, targets=both)
    finally:
        mixing.residual = seen
    assert len(looks) <= 3  # the rounds end where they bring nothing more
    assert mixing.fit(given.limit(0)).count() == 0 and mixing.mix(given.limit(0), targets=targets).count() == 0


def test_a_bound_that_no_factor_ends_above_changes_nothing(spark):
    """Factors that are above the bound only on the way are those that mix() has, so rows come out as often as its weights say."""
    rows = [("s1", "en", "long", 30000.0), ("s1", "", "short", 1.0), ("s0", "", "short", 5.0), ("s0", "en", "short", 5.0), ("s1", "en", "short", 5.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, w double")
    factors = lambda bound: {x[:3]: x["factor"] for x in mixing.rake(cells, bound=bound).select(*mixing.MARGINS, "factor").collect()}
    free = factors(None)
    most = max(free.values())
    assert factors(most * 1.01) == free
    assert factors(most * 0.9) != free and max(factors(most * 0.9).values()) <= most * 0.9


def test_mixing_bounds_the_copies_of_a_rare_cell(spark):
    """One document is to be half of all tokens: it comes out as often as the bound says, and the report says what that leaves unmet."""
    r = random.Random(17)
    rows = [(i, " ".join(r.choices(WORDS, k=100)), "en", "rare" if i == 7 else "common", 1) for i in range(600)]
    given = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("source", "rare", 1.0), ("source", "common", 1.0)], "margin string, value string, weight double")
    out = mixing.sample(given, targets=targets, copies=5).groupBy("doc_id").count().collect()
    times = {x["doc_id"]: x["count"] for x in out}
    assert times[7] == 5 and max(n for i, n in times.items() if i != 7) == 1
    report = {x["value"]: x for x in mixing.fit(given, targets=targets, copies=5).where("margin = 'source'").collect()}
    assert not report["rare"]["met"] and report["rare"]["reached"] == pytest.approx(5 * 100) and report["rare"]["goal"] == pytest.approx(30_000)
    free = {x["value"]: x for x in mixing.fit(given, targets=targets).where("margin = 'source'").collect()}
    assert free["rare"]["met"] and free["common"]["met"]


def test_mixing_sql_follows_the_rounds_of_the_code(spark):
    """Cells that converge slowly need more rounds than the least number; SQL and code stop at the same one."""
    import duckdb

    word = "w "
    sizes = {("s0", "en", "a"): 900, ("s0", "de", "a | b"): 3, ("s1", "en", "a"): 2, ("s1", "de", "a | b"): 800, ("s1", "en", "### b"): 1, ("s0", "de", "### b"): 40, ("s2", "fr", "a"): 5, ("s2", "en", "a | b"): 700}
    rows = [(i, text + " " + word * n, lang, source, 1) for i, ((source, lang, text), n) in enumerate(sizes.items())]
    given = spark.createDataFrame(rows, DOC)
    got = {x["doc_id"]: (x["probability"], x["weight"]) for x in mixing.mix(given).collect()}
    con = duckdb.connect()
    con.register("documents", given.toPandas())
    want = {x[0]: x[1:] for x in con.sql(f"WITH RECURSIVE {mixing.mix_sql('documents')} SELECT doc_id, probability, weight FROM mixed").fetchall()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-9) for i in got)
    few = con.sql(f"WITH RECURSIVE {mixing.mix_sql('documents', most=mixing.ROUNDS)} SELECT doc_id, probability, weight FROM mixed").fetchall()
    assert any(want[x[0]] != pytest.approx(x[1:], abs=2e-9) for x in few)  # more rounds than the least were made


def test_batches_are_sliced_by_bytes():
    import pyarrow as pa

    from meridia.llm.common import by_bytes

    texts = ["a" * 10, None, "b" * 25, "", "é" * 5, "c" * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(by_bytes([batch.slice(0, 0), batch, batch.slice(2, 3)], "text", 20))
    assert [x for p in parts for x in p.column("doc_id").to_pylist()] == [*range(7), 2, 3, 4]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 20 for p in parts)


def test_pipeline_mixing_keeps_the_token_shares(spark, tmp_path):
    """Tokens of what the mixing stage puts out, over all three marginals, against the tempered shares of what went in."""
    import corpus_pipeline

    r = random.Random(17)
    kinds = ["", "", "", " | ", "###"]
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(20, 60))) + r.choice(kinds), r.choice(["en"] * 5 + ["de"]), r.choice(["big"] * 6 + ["s1", "s2"]), 0) for i in range(12_000)]
    given = spark.createDataFrame(rows, DOC)
    count = lambda t: len(t.split())
    look = lambda t: "table" if " | " in t else "markup" if "###" in t else "short" if len(t) < 500 else "medium"
    before, after = {}, {}
    for side, data in ((before, rows), (after, [tuple(x) for x in corpus_pipeline.mixing_stage(spark, given, str(tmp_path)).collect()])):
        for _, t, lang, source, _ in data:
            for key in (("lang", lang), ("source", source), ("topic", look(t))):
                side[key] = side.get(key, 0) + count(t)
    for m in ("lang", "source", "topic"):
        total, kept = sum(n for k, n in before.items() if k[0] == m), sum(n for k, n in after.items() if k[0] == m)
        want = {k: (n / total) ** mixing.ALPHA for k, n in before.items() if k[0] == m}
        assert max(abs(after[k] / kept - x / sum(want.values())) for k, x in want.items()) < 0.01


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    rows = []
    for i in range(300):
        w = r.choices(WORDS, k=r.randint(30, 90))
        rows.append((i, " ".join(w) if i % 5 else " ".join(x + "###" for x in w)))
    rows += [(300 + i, rows[i][1]) for i in range(1, 40)] + [(400, None), (401, "")]
    labels = [(i, int(i % 5 != 0)) for i in range(300)]
    for name, df in (("documents", docs(spark, rows).drop("rep", "recipe", "kept")), ("labels", spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = given
    seen = [set()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        before = at
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        ids = {x["doc_id"] for x in at.select("doc_id").collect()}
        assert ids <= {x["doc_id"] for x in before.select("doc_id").collect()}
        if k < 4:
            assert at.columns == given.columns and isinstance(at.schema["text"].dataType, T.StringType)
        seen.append(ids)
    bad = {i for i, t in rows if t and "###" in t}
    assert not seen[1] & bad and len(seen[1]) >= 0.95 * (len(rows) - len(bad) - 2)
    best: dict = {}
    for i, t in rows:
        if i in seen[1]:
            best[t or ""] = max(best.get(t or "", -1), i)
    assert seen[2] == set(best.values())
    text = dict(rows)
    want = near_brute([(i, text[i]) for i in seen[2]], 5)
    assert seen[3] == {i for i, (_, c) in want.items() if i == c}
    assert seen[5] == seen[4] and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(at.columns)


def test_pipeline_stages_on_null_repeated_and_no_rows(spark, tmp_path):
    """Each stage takes rows with nulls in any column, ties, repeated rows, clashing names and empty tables."""
    import corpus_pipeline

    given = docs(spark, EDGE).unionByName(docs(spark, EDGE[:1]).select("doc_id", "text", *[F.lit(None).cast(t).alias(n) for n, t in docs(spark, []).dtypes[2:]]))
    labels = spark.createDataFrame([(3, 1), (5, 1), (6, 0), (None, 1), (4, None)], "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (given, given.limit(0)):
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            assert (k == 3 or len(rows) <= len(EDGE) + 1) and (df is given or not rows)
            if k == 3 and df is given:  # repeats by the factors: as many of each row as mix() says
                mixed = mixing.mix(given).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability").collect()
                share = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:8], 16) / 2**32
                due = Counter()
                for x in mixed:
                    f = round(x["weight"] * x["probability"], 9) if x["n_tokens"] else min(1.0, x["probability"])
                    due[x["doc_id"]] += int(f) + (share(x["doc_id"]) < f - int(f))
                assert Counter(x["doc_id"] for x in rows) == +due
            assert k == 4 or out.columns == given.columns
            if k == 4 and df is given:
                assert len(rows) == len(EDGE) + 1
    kept = {(x["doc_id"], x["text"]) for x in corpus_pipeline.exact_stage(spark, given, str(tmp_path)).collect()}
    assert {(2, None), (5, EDGE[6][1]), (7, EDGE[8][1]), (4, "ONE"), (3, "one")} <= kept and not {(1, ""), (6, EDGE[7][1])} & kept
    # Without documents, or without labels (each score is 0.5, so none is kept), the whole pipeline gives no rows.
    for name, d, lab in (("none", given.limit(0), labels), ("unlabelled", given, labels.limit(0))):
        d.drop("rep", "recipe", "kept").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_edges_behind_mixing(spark, tmp_path):
    """As the test above, for the stages that may not add rows, and the mixing stage by its kinds of rows."""
    import corpus_pipeline

    given = docs(spark, EDGE)
    mixed = corpus_pipeline.mixing_stage(spark, given, str(tmp_path))
    assert mixed.columns == given.columns and {(x["doc_id"], x["text"]) for x in mixed.collect()} <= set(EDGE)
    encoded = corpus_pipeline.bpe_stage(spark, given, str(tmp_path))
    assert encoded.count() == len(EDGE) and corpus_pipeline.bpe_stage(spark, given.limit(0), str(tmp_path)).count() == 0
    kept = {(x["doc_id"], x["text"]) for x in corpus_pipeline.exact_stage(spark, given, str(tmp_path)).collect()}
    assert {(2, None), (5, EDGE[6][1]), (7, EDGE[8][1]), (4, "ONE"), (3, "one")} <= kept and not {(1, ""), (6, EDGE[7][1])} & kept
    labels = spark.createDataFrame([(3, 1), (5, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int"))
    for name, d, lab in (("none", given.limit(0), labels), ("unlabelled", given, labels.limit(0))):
        d.drop("rep", "recipe", "kept").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
