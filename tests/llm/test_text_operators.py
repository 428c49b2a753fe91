"""Licences, fingerprints, quality rules, near copies, classifier: against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolecast.llm import divergence, imatch, kneser_ney, licenses, simhash
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(frame):
    return [r.asDict() for r in frame.collect()]


# Licences

MIT = """Copyright (c) 2020 Someone
# Permission is hereby granted, free of charge, to any person obtaining a copy of this
# software and associated documentation files (the "Software"), to deal in the Software
# without restriction, including without limitation the rights to use, copy, modify, merge,
# publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
# to whom the Software is furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all copies or
# substantial portions of the Software."""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (MIT, ["MIT"]),
        ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["Apache-2.0"]),
        ("Released under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("# spdx-license-identifier: gpl-2.0-or-later with Classpath-exception-2.0 */", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]),
        ("SPDX-License-Identifier: My-Own-1.0", ["My-Own-1.0"]),
        ("The code here is licensed under the MIT licence.", ["MIT"]),
        ("This is licensed under the BSD 3-Clause License", ["BSD-3-Clause"]),
        ("All of it is available under the two-clause BSD licence, see below.", ["BSD-2-Clause"]),
        ("Code is available under GPLv2+.", ["GPL-2.0-or-later"]),
        ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("word " * 10_000 + "This work is licensed under the MIT License.", ["MIT"]),
        ("Licensed under MIT style terms.", []),
        ("x | y\nLicensed under the GPL v2 or later.", ["GPL-2.0-or-later"]),
        ("No such words here.", []),
        (None, []),
    ],
)
def test_licences(text, expected):
    assert licenses.scan(text)[1] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Released under the GPL v3.", ["GPL-3.0-only"]),
        ("Distributed under the LGPL v2.1.", ["LGPL-2.1-only"]),
        ("Distributed under MPL 2.0.", ["MPL-2.0"]),
        ("Available under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Available under Creative\n# commons BY 4.0.", ["CC-BY-4.0"]),
        ("This work is released under CC0.", ["CC0-1.0"]),
        ("This work is in the public\n# domain.", ["Public-Domain"]),
    ],
)
def test_licences_of_few_words(text, expected):
    assert licenses.scan(text)[1] == expected
    assert licenses.scan("Prose first. " + text)[1] == expected


def test_statements_in_long_runs():
    run = "word " * 3000
    assert licenses.scan(run + "licensed under the Foo licence " + run)[2] == 1
    grant = "# Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    assert licenses.scan(grant.replace(" ", " " * 300))[1] == ["ISC"]
    assert licenses.scan("licence" + " " * 300_000 + "x")[2] == 0  # in no time


def realisations():
    """Every wording that is known, with its identifier and what it tells."""
    out = [(text, *known) for text, known in licenses.WHOLE.items()]
    for filler in ("some thing", "copyright holders and contributors of the work"):
        out += [(f" {filler} ".join(parts).strip(), *known) for group in licenses.GAPPED.values() for known, parts in group]
    out += [(f"{lead} under the {text} license", name, told | {"later": "only"}) for text, (name, told) in licenses.SHORT.items() for lead in ("released", "my own text is licensed")]
    return out


def test_every_known_sentence_is_found():
    for text, name, told in realisations():
        assert licenses.cued(text) and licenses.cued(text.upper()), text
        assert licenses.identify(licenses.normalise(text)) == (name, told), text
    assert licenses.scan("(c) 2020 Someone")[0] == ["copyright"]


def brute_licences(ids):
    """Rules tried in order at every place, over a list whose consumed entries are struck out."""
    left, found = list(enumerate(ids)), []
    for licence, needed in licenses.RULES:
        again = True
        while again:
            again = False
            for i in range(len(left) - len(needed) + 1):
                if [x[0] for _, x in left[i : i + len(needed)]] == list(needed):
                    told = {k: v for _, x in left[i : i + len(needed)] for k, v in x[1].items()}
                    name = licence if "ccv" in told else licence.replace("-$ccv", "")
                    for k in sorted(told, key=len, reverse=True):
                        name = name.replace(f"${k}", told[k])
                    found.append((left[i][0], name))
                    left, again = left[:i] + left[i + len(needed) :], True
                    break
    return [x for _, x in sorted(found)]


def test_scans_against_brute_force():
    draw, known = random.Random(8), realisations()
    by_name = {}
    for one in known:
        by_name.setdefault(one[1], []).append(one)
    for _ in range(300):
        said = []
        while len(said) < 6:  # whole rules, parts of rules, single sentences
            rule = draw.choice(licenses.RULES)[1]
            said += [draw.choice(by_name[n]) for n in rule[: draw.randint(1, len(rule))] if n in by_name]
        lines, unknown = [], 0
        for text, *_ in said:
            for _ in range(draw.randint(0, 2)):
                lines.append(draw.choice(["Plain prose stands here.", "Nothing is granted.", "The dog sat."]))
            if draw.random() < 0.2:
                lines.append("Licensed under the Foo Bar terms.")
                unknown += 1
            words = text.split()
            words[0] = words[0].capitalize()
            at = draw.choice([i for i in range(1, len(words) + 1) if i == len(words) or not words[i][0].isdigit()])  # wrapped, with comment marks
            lines.append(" ".join(words[:at]) + "\n# " + " ".join(words[at:]) + "." if at < len(words) else " ".join(words) + ".")
        ids, licences, n = licenses.scan("\n\n".join(lines))
        assert ids == [name for _, name, _ in said]
        assert licences == brute_licences([(name, told) for _, name, told in said])
        assert n == unknown


def test_license_scan_rows(docs, nothing):
    found = rows(licenses.license_scan(docs))
    assert len(found) == docs.count()
    assert [r["licences"] for r in found if r["doc_id"] == 61] == [["All-Rights-Reserved"] * 3]
    assert licenses.scan("Licensed under the Foo Bar licence of 1987.")[2] == 1
    assert licenses.license_scan(nothing).count() == 0


# I-Match


@pytest.mark.parametrize("group_rows", [500, 2])
def test_edits_against_brute_force(docs, spark, monkeypatch, group_rows):
    import hashlib

    monkeypatch.setattr(imatch, "GROUP_ROWS", group_rows)

    given = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    order = sorted(given, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = Counter()
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        third = len(t) // 3
        want[k, len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()] += 1
    found = rows(imatch.edits(docs, least=0.02, most=0.9))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    by = {r["doc_id"]: r for r in found}
    assert by[50]["fingerprint"] == by[51]["fingerprint"] != by[40 - 1]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert by[51]["near_next"] == 1.0  # 50 is the next of 51
    big = [r for r in found if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in big]) > 3 * np.mean([r["near_next"] for r in big if r["doc_id"] not in (51, 52)])


def test_imatch_hashes_against_brute_force(spark, nothing):
    texts = [prose(i, 60) for i in range(30)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    x = lambda s, seed=42: xxhash.xxh64_intdigest(s, seed)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    sets = [sorted({signed(x(w.lower().encode())) for w in t.split()}) for t in texts]
    n = Counter(h for s in sets for h in s)
    lexicon = {h for h, c in n.items() if max(2, 0.1 * 30) <= c <= 0.5 * 30}
    assert set(imatch.lexicon(frame, "text", 0.1, 0.5)) == lexicon
    found = {r.doc_id: r.fingerprint for r in imatch.fingerprints(frame, least=0.1, most=0.5).collect()}

    def long_hash(value, seed):
        return x(value.to_bytes(8, "little", signed=True), seed & ((1 << 64) - 1))

    for i, s in enumerate(sets):
        want = []
        for family in range(imatch.FAMILIES):
            kept = [h for h in s if h in lexicon]
            for mask in imatch.MASKS:
                # two columns are hashed one after the other, the first's hash seeding the second
                kept = [h for h in kept if x(family.to_bytes(4, "little"), long_hash(h, 42)) & mask == 0]
                acc = 42
                for h in kept:
                    acc = long_hash(h, acc)
                want.append(signed(acc) if kept else 0)
        assert found[i] == want
    assert imatch.fingerprints(nothing).count() == 0 and imatch.edits(nothing).count() == 0
    one = imatch.edits(frame.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_member_tables():
    terms = [hash((i, "t")) for i in range(5000)]
    first, second, bits = imatch._places(terms)
    low = (1 << bits) - 1
    assert all(first[t & low] == t or second[(t >> bits) & low] == t for t in terms)


# Quality rules


def brute_base(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    hit = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_against_brute_force(docs, nothing):
    given = Counter()
    for r in docs.collect():
        n, *rest = brute_base(r.text)
        given[(r.doc_id, n, *rest, n < 50 or 100 * rest[3] > 50 * n)] += 1
    found = rows(divergence.quality_scores(docs))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in found) == given
    assert not any(r["kept"] for r in found if r["base_failed"])
    by = {r["doc_id"]: r for r in found}
    assert by[50]["kept"] and by[56]["kept"] and not by[59]["kept"] and not by[60]["kept"]
    kept = divergence.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert divergence.quality_scores(nothing).count() == 0 and divergence.quality_filter(nothing).count() == 0


def test_jensen_shannon():
    assert divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert divergence.distance(np.array([2.0, 2]), np.array([0.5, 0.5])) == pytest.approx(0)


# SimHash


def brute_print(text):
    found = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
    if not found:
        return 0
    grams = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(prints)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def test_simhash_against_brute_force(docs, nothing):
    given = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    roots = brute_components({p for _, p in given}, 4)
    least = {}
    for k, p in given:
        if k is not None:
            least[roots[p]] = min(k, least.get(roots[p], k))
    want = Counter((k, p, least.get(roots[p])) for k, p in given)
    found = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows(simhash.simhash_groups(docs)))
    assert found == want
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("split_at", [4096, 3])
def test_links_of_clustered_codes(spark, split_at):
    draw = np.random.default_rng(1)
    centres = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = set()
    for c in centres:
        for _ in range(40):
            code = int(c)
            for b in draw.choice(64, draw.integers(0, 5), replace=False):
                code ^= 1 << int(b)
            codes.add(code)
    want = brute_components(codes, 4)
    frame = spark.createDataFrame([(c - (1 << 64) if c >= 1 << 63 else c,) for c in codes], "fp long")
    edges = simhash.link_fingerprints(frame, 4, split_at)
    from rolecast.llm.components import connected_components

    found = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(edges).collect()}
    groups = lambda m: sorted(sorted(x for x in codes if m.get(x, x) == r) for r in {m.get(x, x) for x in codes})
    assert groups(found) == groups(want)


@pytest.mark.parametrize("words", [1, 4])
def test_tree_finds_every_pair(words):
    draw = np.random.default_rng(2)
    codes = draw.integers(0, 4, (300, words), dtype=np.uint64) * np.uint64(0x1111)
    codes = codes[simhash.gray_order(codes)]
    want = {(i, k) for i in range(300) for k in range(i + 1, 300) if simhash.differences(codes[i] ^ codes[k]) <= 3 * words}
    found = {(int(a), int(b)) for x, y in simhash.linked_pairs(codes, 3 * words) for a, b in zip(x, y)}
    assert found == want


def test_gray_order():
    codes = np.arange(16, dtype=np.uint64).reshape(-1, 1)
    assert [int(c) for c in codes[simhash.gray_order(codes)][:, 0]] == [i ^ (i >> 1) for i in range(16)]


def test_dedup_keeps_one_of_each_group(docs, nothing, spark):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 50 in ids and not {51, 52} & set(ids) and ids.count(57) == 1
    assert set(range(40)) <= set(ids) and 56 in ids
    assert simhash.simhash_dedup(nothing).count() == 0


def grams_of(text, n=5):
    found = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def brute_kept(given, least=0.8):
    """The least id of each component over links of at least this Jaccard similarity, from (id, text)."""
    sets = [grams_of(t) for _, t in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                root[find(i)] = find(k)
    groups = {}
    for i, (key, _) in enumerate(given):
        groups.setdefault(find(i), []).append(key)
    return {min(g) for g in groups.values()}


def test_blocks_of_a_large_group_against_brute_force(spark):
    """One candidate with near copies, chains, sets of other sizes and strangers, in blocks of few members."""
    draw = np.random.default_rng(9)
    base = draw.integers(1, 1 << 60, 60).tolist()
    sets = [set(base[: 60 - draw.integers(0, 9)]) | set(draw.integers(1, 1 << 60, draw.integers(0, 5)).tolist()) for _ in range(60)]
    for _ in range(4):  # chains whose ends are not alike
        chain = draw.integers(1, 1 << 60, 40 + int(draw.integers(0, 60))).tolist()
        for _ in range(10):
            sets.append(set(chain))
            chain = chain[len(chain) // 12 :] + draw.integers(1, 1 << 60, len(chain) // 12 + int(draw.integers(0, 3))).tolist()
    sets += [set(draw.integers(1, 1 << 60, int(n)).tolist()) for n in draw.integers(1, 90, 30)]
    rows_of = [(1 if i % 7 else 2, i, " ".join(f"{x:x}" for x in g)) for i, g in enumerate(sets)]
    many = Counter(r[0] for r in rows_of)
    frame = spark.createDataFrame([(c, many[c], i, t) for c, i, t in rows_of * 2], "candidate long, members long, fp long, text string")
    parent = list(range(len(sets)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if rows_of[i][0] == rows_of[k][0] and len(a & b) >= 0.8 * len(a | b):
                parent = [min(parent[i], parent[k]) if r in (parent[i], parent[k]) else r for r in parent]
    for members in (8, 40, 1000):
        found = {r.fp: r.root for r in simhash.similar_classes(frame, 0.8, 1, members).collect()}
        groups = lambda of: sorted(sorted(i for i in range(len(sets)) if of(i) == r) for r in {of(i) for i in range(len(sets))})
        assert groups(lambda i: found.get(i, i)) == groups(lambda i: parent[i])


def test_hot_cells_lose_no_link(spark):
    """All members of a hot cell are candidates together."""
    draw = np.random.default_rng(12)
    base = [f"w{x}" for x in draw.integers(0, 1 << 40, 300)]
    given = []
    for i in range(80):
        words = list(base)
        for at in draw.integers(0, 300, 4):
            words[at] = f"v{i}"
        given.append((i, " ".join(words)))
    given += [(100 + i, " ".join(f"x{x}" for x in draw.integers(0, 1 << 40, 50))) for i in range(20)]
    frame = simhash.with_wide(spark.createDataFrame(given, "doc_id long, text string"), "text", 5).select("fp", "c0", "c1", "c2", "c3")
    from rolecast.llm.components import connected_components

    fps = {r.doc_id: r.fp for r in simhash.with_wide(spark.createDataFrame(given, "doc_id long, text string"), "text", 5).collect()}
    plain, hot = ({r.node: r.root for r in connected_components(simhash.link_similar(frame, 0.8, n)).collect()} for n in (4096, 10))
    together = lambda m: {frozenset(k for k in range(80) if m.get(fps[k], fps[k]) == r) for r in {m.get(fps[k], fps[k]) for k in range(80)}}
    assert all(any(small <= big for big in together(hot)) for small in together(plain)) and len(together(hot)) == 1


def test_dedup_against_exact_similarity(spark):
    draw = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in draw.integers(0, 1 << 40, n)]
    given = []
    for k in range(60):  # a text of 200 shingles and its beginning: similarity 0.80 to 0.84, then 0.60 to 0.795
        words = fresh(204)
        cut = 164 + 2 * (k % 5) if k < 30 else 124 + (k - 30) * 39 // 29
        given += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut]))]
    line = "\n" + " ".join(fresh(20))
    given += [(200 + i, " ".join(fresh(200)) + line * 10) for i in range(4)]  # one line of ten repeats is all they share
    texts = [fresh(100)]
    for i in range(6):  # a chain: each is like the next, the ends are not alike
        texts.append(texts[-1][6:] + fresh(6))
    given += [(300 + i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_kept(given)
    kept = {r.doc_id for r in simhash.simhash_dedup(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert want <= kept  # nothing goes that is not alike
    assert len(kept - want) <= 1  # of 36 links at the edge one may share no cell
    assert {i for i in kept if i >= 200} == {200, 201, 202, 203, 300}


def test_similar_roots_against_brute_force():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 14, draw.integers(1, 12))).astype(np.uint64) for _ in range(120)]
    given = [(i, frozenset(s.tolist())) for i, s in enumerate(sets)]
    root = list(range(120))
    for i, a in given:
        for k, b in given[:i]:
            if len(a & b) >= 0.8 * len(a | b):
                root = [min(root[i], root[k]) if r in (root[i], root[k]) else r for r in root]
    assert simhash.similar_roots(sets, 0.8).tolist() == root


# Classifier


@pytest.fixture(scope="module")
def trusted(spark):
    texts = [(i, prose(1000 + i, 120), "en" if i % 2 else "fr") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i < 380 else 0, None) for i in range(400)] + [(None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return frame, labels


def test_kneser_ney_sums_to_one_and_matches_brute_force(trusted, spark):
    frame, labels = trusted
    found = kneser_ney.fit(frame, labels, kneser_ney.Settings(order=3, sample=150))
    model = found.models.value["en"]
    for context in ("the", "of ", "x", "\x00"):
        every = [np.frombuffer(context.encode() + bytes([b]), np.uint8) for b in range(256)]
        total = sum(2.0 ** -model.bits(c)[-1] for c in every)
        assert total == pytest.approx(1, abs=1e-4)
    # by definition, from the sample that it drew
    drawn = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(300)
    train = drawn.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) != 0).join(frame.where("lang = 'en'"), "doc_id").select("text").collect()
    raw = Counter()
    for r in train:
        t = b"\0\0" + r.text.encode()
        raw.update(t[i : i + 3] for i in range(len(t) - 2))
    levels = {3: raw, 2: Counter(k[1:] for k in raw), 1: Counter(k[1:] for k in {k[1:] for k in raw})}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        level = levels[k]
        t = [sum(1 for c in level.values() if c == i) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2])
        d = lambda c: max(0.05, min(min(c, 3) * 0.95, min(c, 3) - (min(c, 3) + 1) * y * t[min(c, 3) + 1] / t[min(c, 3)])) if t[1] and t[min(c, 3)] else 0.5
        after = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        c = level.get(gram, 0)
        return (c - d(c) if c else 0) / sum(after) + sum(map(d, after)) / sum(after) * p(gram[1:])

    for gram in (b"the", b"he ", b"qqq", b"thq", b"ti\n"):
        assert 2.0 ** -model.bits(np.frombuffer(gram, np.uint8))[-1] == pytest.approx(p(gram), rel=1e-3)


def test_classifier_keeps_prose_and_drops_junk(trusted, docs, nothing, spark):
    frame, labels = trusted
    found = kneser_ney.fit(frame, labels, kneser_ney.Settings(sample=150))
    scored = rows(kneser_ney.scores(docs, found))
    by = {r["doc_id"]: r for r in scored}
    assert len(scored) == docs.count() and all(by[i]["kept"] for i in range(40)) and not by[60]["kept"]
    assert by[53]["bits"] is None and by[53]["kept"] and by[54]["kept"]
    assert kneser_ney.quality_filter(docs, found).columns == docs.columns
    assert kneser_ney.scores(nothing, found).count() == 0
    nobody = kneser_ney.fit(docs, labels.limit(0))
    assert all(r["kept"] for r in rows(kneser_ney.scores(docs, nobody)))


def test_every_trusted_document_trains_or_sets_the_limit(spark):
    """More trusted documents than any sample: all n-grams of one half are known, and the limits are the other half's own."""
    n = 13_000
    texts = [f"{i:05d} {'the ion of and' if i % 5 else 'der und ist die'} {i * 7919 % n:05d} " * 5 for i in range(n)]
    frame = spark.createDataFrame([(i, t, "en" if i % 5 else "de") for i, t in enumerate(texts)] + [(0, "~", "en")], "doc_id long, text string, lang string")
    labels = frame.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = kneser_ney.fit(frame, labels)
    held = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).select("doc_id").collect()}
    models = found.models.value
    assert all(models["en" if i % 5 else "de"].p[5].get(kneser_ney.grams(kneser_ney.text_bytes(t), 5))[1].all() for i, t in enumerate(texts) if i not in held)
    bits = {i: models["en" if i % 5 else "de"].bits(kneser_ney.text_bytes(texts[i])).mean() for i in held}
    own = {"en": [b for i, b in bits.items() if i % 5], "de": [b for i, b in bits.items() if i % 5 == 0], "": list(bits.values())}
    assert found.most == {k: pytest.approx(np.quantile(v, 0.995), rel=1e-9) for k, v in own.items()}


def test_quantiles_are_exact(spark):
    draw = np.random.default_rng(5)
    given = {"a": draw.random(999) * 9, "b": draw.integers(0, 3, 400) / 7.0, "c": np.array([2.5]), "d": 3 + draw.random(700) / (1 << 22), "few": draw.random(0)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in given.items() for x in v], "lang string, bits double")
    for q in (0.0, 0.5, 0.995, 1.0):
        assert kneser_ney.quantiles(rows, q, 1) == {k: pytest.approx(np.quantile(v, q), rel=1e-15) for k, v in given.items() if len(v)}
    assert set(kneser_ney.quantiles(rows, 0.5, 500)) == {"a", "d"} and kneser_ney.quantiles(rows, 0.5, 1000) == {}


def test_texts_are_looked_up_together_as_alone(trusted):
    frame, labels = trusted
    found = kneser_ney.fit(frame, labels)
    texts = [prose(i, 1 + i * i % 900) for i in range(90)] + [None, "", "x", prose(5, 20_000), "\x00\x00", "é" * 3]
    langs = [("en", "fr", None, "xx", "")[i % 5] for i in range(len(texts))]
    for (n, bits, kept), text, lang in zip(kneser_ney.judged(texts, langs, found.models.value, found.most, found.settings), texts, langs):
        codes = kneser_ney.text_bytes(text)
        alone = found.models.value[lang if lang in ("en", "fr") else ""].bits(codes).mean() if len(codes) else None
        assert n == len(codes) and bits == (None if alone is None else pytest.approx(alone, rel=1e-9))
        assert kept == (n < 100 or alone <= found.most[lang if lang in ("en", "fr") else ""] + 0.02 + 150 / n)


def test_open_addressing():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 40, 5000))
    table = kneser_ney.Table(keys, np.arange(len(keys), dtype=np.float32))
    value, found = table.get(np.concatenate([keys, keys + (1 << 41)]))
    assert found[: len(keys)].all() and not found[len(keys) :].any() and (value[: len(keys)] == np.arange(len(keys))).all()
