"""Near-dedup, decontamination, line dedup and licence scan against brute force."""

import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frontrank.llm import decontamination, license_scan, line_dedup, near_dedup
from frontrank.llm.common import bag, word_hashes


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus():
    rng = random.Random(5)
    rows = []
    for base in range(12):
        w = words(rng, rng.randint(40, 120)) * rng.choice([1, 2])
        for _ in range(rng.randint(1, 8)):
            own = list(w)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = "edited"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(120):
        h = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
        a = rng.integers(1, 9, len(h))
        b = np.where(rng.random(len(h)) < 0.6, a, rng.integers(0, 9, len(h)))
        s = near_dedup.signatures([(h, a), (h[b > 0], b[b > 0])])
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015


def test_classes_are_the_components(spark):
    rows = corpus()
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= near_dedup.THRESHOLD and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root(i) for i, _ in rows}


def edited(rng, w, edits):
    """w with so many words replaced, left out or put in."""
    own = list(w)
    for _ in range(edits):
        i, kind = rng.randrange(len(own)), rng.random()
        own[i : i + (kind < 0.9)] = [] if kind < 0.2 else [rng.choice(["alpha", "beta", f"x{rng.random()}"])]
    return own


def brute_classes(rows):
    """The smallest linked id of each id, over all pairs."""
    bags = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            small, large = sorted((sum(bags[x].values()), sum(bags[y].values())))
            if small >= 0.8 * large and root(i) != root(j) and jaccard(bags[x], bags[y]) >= near_dedup.THRESHOLD:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def test_many_copies_just_below_the_threshold(spark):
    """Copies edited to about 0.8 of the original, some of them copied in turn: no link is lost, and few pairs are made."""
    rng = random.Random(8)
    base = words(rng, 150)
    own = [edited(rng, base, rng.choice([1, 3, 4, 5, 6, 7, 8])) for _ in range(420)]
    own += [edited(rng, rng.choice(own[100:]), rng.choice([1, 2, 3, 4])) for _ in range(80)]
    rng.shuffle(own)
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert got == expected and 20 < len(set(expected.values())) < 400


def test_candidates_hold_all_links(spark):
    """Every linked pair of members that have a hub in common is a candidate, unless both are links of the hub."""
    rng = random.Random(11)
    base = words(rng, 60) * 2
    own = [base] + [edited(rng, base, rng.choice([1, 2, 3, 4, 6])) for _ in range(60)]
    own += [edited(rng, rng.choice(own[20:]), rng.choice([0, 1, 1, 2])) for _ in range(90)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    bags = [shingles(t) for _, t in rows]
    members = spark.createDataFrame([(0, i, i) for i in range(1, len(rows))], "h long, x long, class long")
    got = {(r["a"], r["b"]) for r in near_dedup.candidates(members, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {(i, j) for j in range(1, len(rows)) for i in range(1, j) if jaccard(bags[i], bags[j]) >= 0.8 and min(jaccard(bags[0], bags[i]), jaccard(bags[0], bags[j])) < 0.8}
    assert linked <= got and len(linked) > 100 and len(got) < len(rows) ** 2 / 4


def test_repeated_ids_with_different_texts(spark):
    """A doc_id that stands for a short and a long text: both keep their links."""
    rng = random.Random(3)
    short, long, third = words(rng, 70), words(rng, 200), words(rng, 150)
    copies = [edited(rng, w, 1) for w in (short, long, third, third)]
    rows = [(9, " ".join(short)), (9, " ".join(long)), *((i, " ".join(w)) for i, w in enumerate(copies))]
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 0), (0, 0), (1, 0), (2, 2), (3, 2)}


def test_near_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(odd_docs).collect()}
    assert {(2, 2), (3, 2), (5, 2), (1, 1), (None, None)} <= got
    kept = near_dedup.one_of_each(odd_docs)
    assert kept.columns and set(kept.columns) == set(odd_docs.columns)
    assert near_dedup.near_dedup(no_docs).count() == 0


def test_leaks_against_all_windows(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 5, 14, 20, 33, 59])] + [(90, ""), (91, None)]
    docs = []
    for i in range(40):
        w = words(rng, rng.randint(0, 80))
        if i % 3 == 0:
            t = items[rng.randrange(6)][1].split()
            if i % 2 and len(t) > 10:
                t[0] = "changed"
            x = rng.randint(0, len(w))
            w[x:x] = t
        docs.append((i, " ".join(w)))
    expected = {}
    for d, text in docs:
        w = text.lower().split()
        for i, t in items:
            if not t:
                continue
            own, n = shingles(t), len(t.split())
            best = max((jaccard(shingles(" ".join(w[s : s + n])), own) for s in range(max(1, len(w) - n + 1))), default=0)
            if w and best >= decontamination.THRESHOLD:
                expected[d, i] = round(best, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.contaminated(table, bench).collect()}
    assert got == expected and len(got) >= 10
    clean = {r["doc_id"] for r in decontamination.decontaminated(table, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in expected}


def test_items_without_id_and_long_texts_in_runs(spark):
    rng = random.Random(1)
    items = [(None, " ".join(words(rng, 12))), (5, " ".join(words(rng, 30)))]
    text = " ".join([*words(rng, 3000), items[0][1], *words(rng, 2000), items[1][1], items[1][1], *words(rng, 900), items[0][1]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    found = lambda: sorted((str(r["item_id"]), r["start_word"], r["n_words"], r["similarity"]) for r in decontamination.contaminated(docs, bench).collect())
    assert found() == [("5", 5012, 30, 1.0), ("None", 3000, 12, 1.0)]
    assert [r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()] == [2]
    starts = np.array([1, 2, 5, 9, 300, 301])
    assert [r.tolist() for r in decontamination.in_reach(starts, 5)] == [[1, 2, 5], [9], [300, 301]]


def test_blocks_lose_none_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (5, 8), dtype=np.uint8)
    index = decontamination.BlockIndex(prints)
    for _ in range(300):
        i = int(rng.integers(5))
        bits = np.unpackbits(prints[i])
        n = int(rng.integers(0, decontamination.RADIUS + 1))
        bits[rng.choice(64, n, replace=False)] ^= 1
        _, which, away = index.near(np.packbits(bits)[None, :])
        assert n in away[which == i]


def test_long_passages_over_pieces_and_wide_edits(spark, monkeypatch):
    """Small pieces and a tiny bit map full of false hits give what all windows give, with many items that share shingles."""
    monkeypatch.setattr(decontamination, "PIECE", 8)
    monkeypatch.setattr(decontamination, "LEAST_BITS", 6)
    monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    rng = random.Random(4)
    head = words(rng, 12)
    items = [(i, " ".join([*head, *words(rng, rng.randint(1, 40))])) for i in range(12)]
    docs = []
    for i in range(30):
        t = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "other"
        docs.append((i, " ".join([*words(rng, rng.randint(0, 30)), *t[rng.randint(0, 3) :], *words(rng, rng.randint(0, 30)), *head])))
    expected = {}
    for d, text in docs:
        w = text.split()
        for i, t in items:
            own, n = shingles(t), len(t.split())
            best = max(jaccard(shingles(" ".join(w[s : s + n])), own) for s in range(max(1, len(w) - n + 1)))
            if best >= decontamination.THRESHOLD:
                expected[d, i] = round(best, 9)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.contaminated(table, bench).collect()}
    assert got == expected and len(got) >= 10


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog")], "item_id long, text string")
    assert decontamination.contaminated(odd_docs, bench).count() == 3
    assert decontamination.decontaminated(odd_docs, bench).columns == odd_docs.columns
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.decontaminated(odd_docs, bench.limit(0)).count() == 9


def test_templates_with_variable_fields(spark):
    rows = [(i, f"user {i} logged in from host{i} today ok\nown line {chr(97 + i) * 3} {chr(98 + i) * 4} x\n\nfooter text here") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_templates(docs).collect()}
    assert got == {i: f"own line {chr(97 + i) * 3} {chr(98 + i) * 4} x\n" for i in range(12)}


def test_lines_of_mostly_digits_recur(spark):
    same = ["Page 3 of 10", "Copyright 2020 Example", "Updated 2021-03-04 10:15 by admin", "Tel: +49 30 1234567", "2024"]
    rows = [(i, "\n".join([*same, f"Part {i}", f"{i}00", f"own {chr(97 + i) * 3} words here"])) for i in range(12)]
    docs = spark.createDataFrame([*rows, (12, "Page 4\nTel: 12\n77\n78")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_templates(docs).collect()}
    assert got == {i: f"{i}00\nown {chr(97 + i) * 3} words here" for i in range(12)} | {12: "Page 4\nTel: 12\n77\n78"}


def test_long_passages_in_three_documents(spark):
    rng = random.Random(5)
    passage, pair, copied = (" ".join(f"w{c}".translate(str.maketrans("0123456789", "abcdefghij")) for c in rng.sample(range(1000), 60)) for _ in range(3))
    numbers = " ".join(["total", *(str(rng.randrange(1000)) for _ in range(30))])
    other = " ".join(["total", *(str(rng.randrange(1000)) for _ in range(30))])
    rows = [(i, f"own {chr(97 + i) * 4}\n{passage}\n{numbers}\nshort line") for i in range(3)]
    rows += [(i, f"own {chr(97 + i) * 4}\n{pair}\n{other if i == 3 else 'x'}") for i in (3, 4)]
    rows += [(i, f"one text\n{copied}") for i in (5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_templates(docs).collect()}
    assert got == {i: f"own {chr(97 + i) * 4}\nshort line" for i in range(3)} | {i: t for i, t in rows if i > 2}


def plain_line_dedup(rows, min_docs):
    """The template tree in plain Python: (doc_id, text) -> text without recurring lines."""
    docs = {(i, t or "") for i, t in rows}
    squeezed = lambda line: " ".join(line.split())
    masked = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())
    key = lambda line: squeezed(line) if set(masked(line).split()) == {"<*>"} else masked(line)
    own, leaves, far = {}, {}, {}
    for d in docs:
        for line in filter(str.strip, d[1].split("\n")):
            k, tokens = key(line), masked(line).split()
            own.setdefault(k, set()).add(d)
            leaves.setdefault(k if set(tokens) == {"<*>"} else (len(tokens), *tokens[:4]), set()).add(k)
            if len(tokens) >= 20:
                far.setdefault(masked(line) if tokens.count("<*>") <= 0.3 * len(tokens) + 1e-9 else squeezed(line), set()).add(d[1])
    bad = {k for k, d in own.items() if len(d) >= min_docs}
    for ks in leaves.values():
        having, shapes = {}, {}
        for k in ks:
            for place, t in enumerate(k.split()):
                having.setdefault((place, t), set()).update(own[k])
        for k in ks:
            fixed = tuple((p, t) for p, t in enumerate(k.split()) if not re.search("[0-9]|<", t) and len(having[p, t]) >= min_docs)
            if len(fixed) >= 0.7 * len(k.split()):
                shapes.setdefault(fixed, set()).add(k)
        for same in shapes.values():
            if len(set().union(*(own[k] for k in same))) >= min_docs:
                bad |= same
    wide = {k for k, d in far.items() if len(d) >= min(3, min_docs)}

    def stays(line):
        return not line.strip() or key(line) not in bad and not (len(line.split()) >= 20 and (masked(line) in wide or squeezed(line) in wide))

    return {(i, t): "\n".join(filter(stays, (t or "").split("\n"))) for i, t in rows}


def test_line_dedup_against_plain_python(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(0, 9)):
            w = rng.choice([["user", "went", "to", "a"], ["on", "host", "7", "the"], ["b"]]) + [rng.choice(["a", "a", "b", "x9", "77", rng.choice("defghijk") * 3]) for _ in range(rng.randint(0, 4))]
            lines.append(rng.choice(["", "12 34", " ".join(w), " ".join(w), "  ".join(w), " ".join(w * 4), " ".join([f"n{rng.random()}"] * 3)]))
        rows.append((rng.choice([None, *range(90)]), "\n".join(lines)))
    rows += rng.choices(rows, k=20) + [(None, None), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (3, 6):
        got = Counter((r["doc_id"], r["text"]) for r in line_dedup.without_templates(docs, least).collect())
        expected = plain_line_dedup(rows, least)
        assert got == Counter((i, expected[i, t]) for i, t in rows)
        assert sum(len(t or "") for _, t in rows) > 1.1 * sum(len(t) for _, t in got.elements())


def test_ids_with_two_texts_lose_only_their_own_lines(spark):
    rows = [(1, "only here\nfooter of all"), (1, "footer of all\nanother line"), *((None, f"footer of all\nown {c}") for c in "abcd")]
    got = Counter(r["text"] for r in line_dedup.without_templates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == Counter(["only here", "another line", *(f"own {c}" for c in "abcd")])


def test_many_dropped_lines_in_one_text(spark):
    text = "\n".join("again and again" if i % 2 else f"line {'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(400))
    docs = spark.createDataFrame([(1, text), *((i, "again and again") for i in range(2, 12))], "doc_id long, text string")
    got = {r["doc_id"]: (r["__dropped"], r["text"]) for r in line_dedup.without_templates(docs).collect()}
    assert got[1] == (200, "\n".join(text.split("\n")[::2])) and got[2] == (1, "")


def test_line_dedup_odd_rows(odd_docs, no_docs):
    out = line_dedup.without_templates(odd_docs, min_docs=2)
    assert out.count() == 9 and line_dedup.without_templates(no_docs).count() == 0
    clashing = odd_docs.withColumnsRenamed({"kept": "line", "score": "number"}).withColumns({"dropped": F.lit(1), "leaf": F.lit(2), "__dropped": F.lit(7)})
    out = line_dedup.without_templates(clashing, min_docs=2)
    assert sorted(out.columns) == sorted(clashing.columns) and {r["__dropped"] for r in out.collect()} <= {0, 1}


def test_licences(spark, odd_docs, no_docs):
    rows = [(1, "Some code\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0"), (3, "Released under the old terms of nobody"), (4, "licensed under cc by-nc 4.0!")]
    got = {(r["doc_id"], r["line"], r["license"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.TEMPLATES).collect()}
    assert got == {(1, 2, "MIT"), (2, 0, "Apache-2.0"), (4, 0, "CC-BY-NC-4.0")}
    assert license_scan.license_scan(odd_docs, license_scan.TEMPLATES).count() == 0
    assert license_scan.license_scan(no_docs, license_scan.TEMPLATES).count() == 0


def test_licences_that_wrap_or_stand_inside_a_line(spark):
    code = "\n".join(f"def part{i}(a, b): return a * {i} + b" for i in range(40))
    mit, bsd, gpl = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["BSD-3-Clause"][1], license_scan.TEMPLATES["GPL-3.0"][1]
    wrapped = lambda text: "\n".join(f"# {line}" for line in textwrap.wrap(text, 74))
    inside = "The parser in this folder was written last year by the core team. This work is licensed under the GNU General Public License, version 3. Ask them before you change any of it, please."
    rows = [(i, f"first line\n{wrapped(t)}\n{code}") for i, t in enumerate([mit, bsd, gpl, license_scan.TEXTS["MIT"][0], license_scan.TEXTS["BSD-3-Clause"][0]])]
    rows += [(5, inside), (6, f"{code}\n{inside}"), (7, code), (8, f"{code}\nReleased under\nthe MIT License.\n{wrapped(gpl)}\nReleased under the MIT License."), (9, " ".join(inside.split()[:14]))]
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.TEMPLATES).collect())
    assert got == [(0, 2, "MIT"), (1, 2, "BSD-3-Clause"), (2, 2, "GPL-3.0"), (3, 2, "MIT"), (4, 2, "BSD-3-Clause"), (5, 0, "GPL-3.0"), (6, 41, "GPL-3.0"), (8, 41, "MIT"), (8, 43, "GPL-3.0"), (8, 43 + len(wrapped(gpl).split("\n")), "MIT")]


def test_key_words_are_in_every_match():
    ratio = license_scan.DICE / (2 - license_scan.DICE)
    rng = random.Random(4)
    for texts in license_scan.TEMPLATES.values():
        for t in texts:
            own = license_scan.plain_bigrams(t)
            keys = license_scan.key_words(own, ratio)
            for _ in range(50):
                kept = rng.sample(own, max(1, int(np.ceil(ratio * len(own) - 1e-9))))
                assert any(k in b.split() for b in kept for k in keys)


def test_few_words_are_one_shingle():
    hashes, offsets = word_hashes(pa.array(["a b", "A  b", "a b c", ""]))
    bags = [bag(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert bags[0][0].tolist() == bags[1][0].tolist() != bags[2][0].tolist() and len(bags[3][0]) == 0
