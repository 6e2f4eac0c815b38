"""Importance resampling, suffix-array dedup and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm import DOC, EDGE, WORDS, docs

from meridia.llm import alignment, importance, lengths, licences, suffix_dedup


def sorted_rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def resample_brute(rows, target, longest, buckets, least, percent):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    held = [features(t) for _, t in rows]
    s, t = Counter(b for f in held for b in f), Counter(b for x in target for b in features(x))
    every, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (every + buckets) / ((s[b] + 1.0) * (aim + buckets)))) for b in range(buckets)}
    out = []
    for (i, text), f in zip(rows, held, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for x in out:
        x[4:] = [None]
    for r, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = r + 1
    return sorted((tuple(x) for x in out), key=repr)


@pytest.mark.parametrize(("longest", "piece"), [(1, 1 << 20), (1, 50), (3, 40)])
def test_importance_equals_brute_force(spark, monkeypatch, longest, piece):
    r = random.Random(longest)
    rows = [(i, " ".join(r.choices([*WORDS, "Émile", "ÉTÉ", "a_b", "don't", "x1Y2", "日本", "\x00", "--"], k=r.randint(0, 90)))) for i in range(150)] + EDGE
    target = [" ".join(r.choices(WORDS[:9], k=30)) for _ in range(20)] + [None, ""]
    monkeypatch.setattr(importance, "PIECE", piece)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted_rows(importance.resample(docs(spark, rows), aim, buckets=500, longest=longest, least=3, percent=25))
    assert got == resample_brute(rows, target, longest, 500, 3, 25)


def test_importance_edges(spark):
    aim = spark.createDataFrame([(None,)], "text string")
    got = sorted_rows(importance.resample(docs(spark, EDGE), aim))
    assert [(x[0], x[1]) for x in got] == sorted([(i, len(words_of(t))) for i, t in EDGE], key=repr)
    assert importance.resample(docs(spark, []), aim).count() == 0
    gain = np.array([5, -3, 0, 1000, -1], np.int64)
    planes = importance.gain_planes(gain)
    at, n, row = np.array([0, 3, 1, 4, 2]), np.array([7, 1, 1 << 20, 3, 9]), np.array([0, 0, 1, 1, 3])
    assert importance.plane_sums(at, n, row, 4, planes, 5).tolist() == [5 * 7 + 1000, -3 * (1 << 20) - 3, 0, 0]


def repeats_brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in texts for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, texts, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeating(r):
    text = lambda n: " ".join(r.choices(WORDS, k=n))
    common = [text(60) for _ in range(6)]
    rows = [(i, " ".join(r.choice([text(r.randint(1, 60)), r.choice(common), r.choice(common)[r.randint(0, 50) :]]) for _ in range(r.randint(1, 8)))) for i in range(80)]
    rows += [(500 + i, t) for i, t in enumerate(["x " * 3000, "x " * 99, "x" * 201, "x" * 200, "é☃" * 150, "z" * 5000 + text(100)])]
    return rows + [(900 + i, text(50) + common[0] + text(50)) for i in range(30)] + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("length", "hot"), [(200, 2048), (200, 3), (24, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, hot):
    rows = repeating(random.Random(length + hot)) + EDGE
    monkeypatch.setattr(suffix_dedup, "TASK", 64)
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(3), length=length, hot=hot)
    assert sorted_rows(got) == repeats_brute(rows, length)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_rows_of_hot_stretches(spark, monkeypatch):
    """Stretches that share an anchor cost some rows each, not one for each of their windows, and lose no match with blocks that are settled before."""
    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage, tail = text(400), text(150)
    rows = [(i, text(30) + passage + text(300)) for i in range(60)]  # each goes on in its own way
    rows += [(100 + i, text(30) + passage + tail[: 10 * (i // 3)] + text(100)) for i in range(45)]  # shares 0 to 140 more bytes with others
    rows += [(200 + i, passage[i:] + tail[: 7 * i] + "-" * 300 + text(50)) for i in range(20)]
    made, stored = Counter(), suffix_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] += out.count() if name.startswith("hot-") else 0
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    got = suffix_dedup.remove_repeats(docs(spark, rows), hot=8)
    assert sorted_rows(got) == repeats_brute(rows, 200)
    assert 0 < max(made.values()) < 6000


def test_kept_bytes_and_texts_in_segments(spark):
    r = random.Random(8)
    passage = " ".join(r.choices(WORDS, k=50))
    long = " ".join(str(r.random()) for _ in range(60_000))  # over one MB: looked at in segments
    rows = [(1, long[:600_000] + passage + long[600_000:]), (2, "A" + passage + "B")]
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=True).collect()}
    assert got == {1: long.encode(), 2: b"AB"}


def test_family_grows_geometrically():
    r = random.Random(3)
    family, parts = suffix_dedup.Family(20), []
    for _ in range(40):
        batch = [bytes(r.choices(b"ab\x00", k=r.randint(20, 60))) for _ in range(5)] + [b"\x00" * 25]
        parts += batch
        family.add(batch)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((x.windows[1:] > x.windows[:-1]).all() for x in family.levels)
    windows = [p[i : i + 20] for p in parts for i in range(len(p) - 19)]
    n = Counter(windows)
    assert family.repeated().tolist() == [n[w] > 1 for w in windows]


def align_brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.byte_file())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_file())
    letters = alignment.byte_alphabet()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held, count = [], Counter()
    for i, text in rows:
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        tokens = [[bytes(letters[c] for c in a.id_to_token(x)) for x in ids[0]], [piece(x) for x in ids[1]]]
        if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
            held.append((i, None))
            continue
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in tokens]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for e in both:
            last = [ends[s].index(e) + 1 for s in (0, 1)]
            part = [list(zip(ids[s][at[s] : last[s]], tokens[s][at[s] : last[s]], ends[s][at[s] : last[s]], strict=True)) for s in (0, 1)]
            groups.append(";".join(",".join(str(x[0]) for x in p) for p in part))
            links += [(x, y) for x, t, f in part[0] for y, u, g in part[1] if max(f - len(t), g - len(u)) < min(f, g)]
            at = last
        count.update(set(links))
        held.append((i, (len(ids[0]), len(ids[1]), len(both), links, "|".join(groups))))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for i, h in held:
        row = (0, 0, 0, 0, 0, 0, "")
        if h:
            row = (*h[:3], len(h[3]), sum(count[x] == best[x[0]] for x in h[3]), sum(count[x] for x in h[3]), hashlib.sha256(h[4].encode()).hexdigest())
        out.append((i, *row))
    return sorted(out, key=repr)


ODD = ["a▁b c", "  lead", "trail  ", "\n\nx y", "<|endoftext|> hi <s> </s> <0x41>", " " * 3000, "a" * 3000, "x   　y", "日本 語 テキスト", "ﬁ ½ é é   x", "a\tb c\x1cd \x1c e", "᠎ x ᠎ y", "👩‍👩‍👧 ok", " ", "don't  stop 12 345"]


@pytest.mark.parametrize("common", [1 << 19, 40, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, common):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([*WORDS, "the", "Unbelievable!", "naïve", "3.14", "\n", ""], k=r.randint(1, 60)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + EDGE
    monkeypatch.setattr(alignment, "TOGETHER", 400)
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    monkeypatch.setattr(alignment, "COUNTED", 300)
    assert sorted_rows(alignment.align(docs(spark, rows), common=common)) == align_brute(rows)
    assert alignment.align(docs(spark, [])).count() == 0


def test_long_texts(spark):
    """A million blanks, letters and line ends, and a long text without any stretch that repeats."""
    n = 1_000_000
    rows = [(1, " " * n), (2, "a" * n), (3, "\n" * n), (4, "é" * n)]
    d = spark.createDataFrame([(i, t, "", "", n) for i, t in rows], DOC)
    got = {x["doc_id"]: x for x in alignment.align(d).collect()}
    assert [got[i]["n_a"] > 0 and got[i]["n_b"] > 0 for i in (1, 2, 3, 4)] == [True] * 4
    assert [(x[2], x[3]) for x in sorted_rows(suffix_dedup.remove_repeats(d))] == [(n, 1), (n, 1), (n, 1), (2 * n, 1)]
    assert sorted((x["doc_id"], x["n_features"]) for x in importance.resample(d, d.limit(0)).collect()) == [(1, 0), (2, 1), (3, 0), (4, 1)]


def test_pieces_and_memory_in_process(monkeypatch):
    """What tasks do with small bounds, which patched bounds don't reach in workers."""
    r = random.Random(9)
    text = " ".join(r.choices([*WORDS, "a--b", "É"], k=400))
    want = Counter(zlib.crc32(" ".join(words_of(text)[i : i + n]).encode()) % 97 for n in (1, 2, 3) for i in range(len(words_of(text)) - n + 1))
    for piece in (1, 30, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        monkeypatch.setattr(importance, "REMEMBERED", 10)
        at, n, features, words = importance.Bucketer(97, 3).count(text.encode())
        assert (dict(zip(at.tolist(), n.tolist(), strict=True)), features, words) == (dict(want), sum(want.values()), len(words_of(text)))
    with open(alignment.byte_file(), encoding="utf-8") as f, open(alignment.piece_file(), "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    texts = [" ".join(r.choices(WORDS, k=30)) for _ in range(20)]
    whole = [aligner.align([t])[0] for t in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 12)
    for _ in range(2):
        for t, w in zip(texts, whole, strict=True):
            parts = aligner.stretches([t])[0]
            assert tuple(sum(p[i] for p in parts) for i in range(3)) == w[:3] and b"".join(p[4] for p in parts) == w[4]
            assert b"".join(p[3] for p in parts) == w[3]


def test_runs_of_blanks_are_counted_apart_alike():
    with open(lengths.rank_file(), "rb") as f:
        encoding = lengths.load(f.read(), lengths.pattern())
    r = random.Random(12)
    for _ in range(3000):
        text = "".join(r.choices([" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "a", "b1", "'s", "!", "é"], k=r.randint(0, 14)))
        for least in (1, 2, 3):
            assert lengths.token_count(encoding, text, least=least) == len(encoding.encode_ordinary(text)), repr(text)


def test_lengths_of_very_long_texts(spark):
    """Runs of 1 and 16 million blanks, letters and line ends, at the end of a text and within it."""
    n = 1_000_000
    rows = [(1, " " * n), (2, "\n" * n + "x"), (3, "a" * n), (4, "x" + " " * 16 * n + "y"), (5, "\n" * 4 * n), (6, "é" * 4 * n)]
    got = {x["doc_id"]: x["n_tokens"] for x in lengths.encoded_lengths(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A blank is a token of its own; line ends go in pairs; the blank before y goes with it.
    assert got == {1: n, 2: (n - 1 + 1) // 2 + 2, 3: n // 4, 4: 1 + 16 * n - 1 + 1, 5: 2 * n, 6: 4 * n}


def gnu(name, version):
    return f"// Copyright (C) 2019 A. Author\n//\n// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU {name} as published by\n// the Free Software Foundation; either version {version} of the License, or\n// (at your option) any later version.\n//\n// This program is distributed in the hope that it will be useful,\n// but WITHOUT ANY WARRANTY; without even the implied warranty of\n// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n// GNU {name} for more details.\nint main;\n"


def test_relatives_are_told_apart_or_unknown(spark):
    bsd = next(t for n, t in licences.NOTICES if n == "BSD-2-Clause" and "Redistribution" in t)
    files = [
        ("a/x.c", gnu("General Public License", "2"), "GPL-2.0"),
        ("b/x.c", gnu("General Public License", "3"), "GPL-3.0"),
        ("c/x.c", gnu("Lesser General Public License", "3"), "LGPL-3.0"),
        ("d/x.c", gnu("Lesser General Public License", "2.1"), "LGPL-2.1"),
        ("e/x.c", gnu("Affero General Public License", "3"), "AGPL-3.0"),
        ("f/x.c", gnu("Library General Public License", "2"), "unknown"),
        ("g/x.c", gnu("General Public License", "4"), "unknown"),
        ("h/LICENSE", "Copyright (c) 2019, A. Author\n\n" + bsd, "BSD-2-Clause"),
        ("h/y.c", "int y;", "BSD-2-Clause"),
        ("i/x.c", "// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("j/x.c", "// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("k/x.c", "// SPDX-License-Identifier: CC0-1.0", "CC0-1.0"),
        ("l/COPYING", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n\n" + "preamble " * 300, "AGPL-3.0"),
        ("m/x.c", "// Licensed under the Apache License, Version 1.1", "unknown"),
        ("n/x.c", "int n;", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {x["path"]: (x["license"], x["inherited_from"]) for x in licences.scan(df).collect()}
    assert {p: got[p][0] for p, _, _ in files} == {p: w for p, _, w in files}
    assert got["h/y.c"][1] == "h"
