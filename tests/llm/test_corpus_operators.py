"""Packing, archive, language model, mixing, chat, pipeline: round trips and brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecast.llm import chat, common, mixing, neural_lm, packing, warc
from rolecast.llm.common import scratch
from tests.llm.conftest import SCHEMA, document, prose


def rows(frame):
    return [r.asDict() for r in frame.collect()]


# Packing


def test_pieces_against_the_tokenizer(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size, want = 256, Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = rows(packing.pack_documents(docs, size))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    full = defaultdict(list)
    for r in found:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(r["length"] for r in found) // size)
    assert len(full) <= least + 2
    assert packing.pack_documents(nothing).count() == 0


def test_fast_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, exact = packing.tokens(path), Tokenizer.from_file(path)
    assert fast.fast is not None
    for text in ("", " ", "a  b\n\n c", "it's 12 o'clock, <|endoftext|> then", "naïve Ünï 😀😀 日本語", "\ufeff\u00a0x\r\n\t", prose(3, 50)):
        assert fast.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def longest_first(task):
    """Best fit of all pieces, longest first: what breeding has to beat."""
    every = np.arange(len(task.lengths))
    return task.best_fit(np.full(len(every), -1, np.int32), task.longest_first(every))


@pytest.mark.parametrize(("low", "high", "n"), [(250, 500, 1000), (150, 400, 1500), (100, 450, 1500)])
def test_breeding_beats_its_seeds_and_plain_best_fit(low, high, n):
    lengths = np.random.default_rng(5).integers(low, high, n)
    task, how = packing.Problem(lengths, 1024, 1), packing.Evolution(generations=90)
    seeds = [task.start() for _ in range(how.population)]
    found, ran = task.evolve(seeds, how)
    for bins in (*seeds, *found, task.cross(found[0], seeds[0], how), task.mutate(seeds[0], how)):
        assert len(bins) == n and (bins >= 0).all() and task.fills(bins).max() <= 1024
    bins = len(set(found[0].tolist()))
    assert task.least <= bins < min(len(set(s.tolist())) for s in seeds)
    assert bins < len(set(longest_first(task).tolist()))
    assert ran == 90 or bins == task.least


def test_generations_run_and_elites_travel(spark):
    lengths = np.random.default_rng(6).integers(250, 500, 600).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "row long, length int")
    how = packing.Evolution(problem=300, rounds=2, generations=15)
    one = {(r.problem, r.island): r for r in packing.bred(items, 1024, packing.Evolution(problem=300, rounds=1, generations=15)).collect()}
    two = {(r.problem, r.island): r for r in packing.bred(items, 1024, how).collect()}
    assert len(two) == 4 and all(r.generations == 30 for r in two.values())
    for (problem, island), r in two.items():  # no island is worse than its neighbour's elite was
        assert r.bins <= min(one[problem, island].bins, one[problem, 1 - island].bins)
    placed = packing.pack(items, 1024, how).collect()
    assert len(placed) == 600 and len({r.sequence_id for r in placed}) == sum(min(r.bins for (p, _), r in two.items() if p == q) for q in {p for p, _ in two})


def test_crossover_keeps_the_injected_bins():
    task, how = packing.Problem(np.array([6, 4, 5, 5, 7, 3, 2]), 10, 3), packing.Evolution(inject=1.0)
    other = np.array([0, 0, 1, 1, 2, 2, 3], np.int32)
    one = task.best_fit(np.full(7, -1, np.int32), np.array([4, 0, 2, 3, 1, 5, 6]))
    child = task.cross(one, other, how)
    groups = {tuple(np.flatnonzero(child == b)) for b in set(child.tolist())}
    assert len({(0, 1), (2, 3), (4, 5)} & groups) >= 1 and task.fills(child).max() <= 10


# Archive


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 200 + "é</p>", "<p>" + "y" * 120
    data = [(1, "http://a/%0D%25\r\nx", big, "k"), (1, "http://a/%0D", "other of 1", "k"), (2, "http://b", big, "k"), (3, None, other, "k"), (4, "http://d", "small", "k"), (5, "http://e", "small", "k"), (6, "http://f", None, "k"), (7, "http://g", "", "k"), (None, "http://h", big, "k"), (2, "http://b2", big, "k"), (8, "u", "z" * 100, "k"), (9, "u", "z" * 100, "k"), (10, "u", "z" * 99, "k"), (11, "u", "z" * 99, "k")]
    return spark.createDataFrame(data, "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark, pages):
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    found = Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(warc.catalogue(spark, path)))
    want, seen = Counter(), set()
    for r in sorted(pages.collect(), key=lambda r: (r.page_id is None, r.page_id, r.url)):
        raw = (r.html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and digest in seen
        seen.add(digest)
        first = min((p.page_id for p in pages.collect() if p.html == r.html and p.page_id is not None), default=None)
        want[r.page_id, len(raw), digest, "revisit" if again else "response", first if again else None] += 1
    assert found == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({(r.html or "") for r in pages.collect()})
    for r in warc.records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\n")
    told = warc.headers(spark, path).collect()
    assert Counter((r.key, r.url) for r in told) == Counter((r.page_id, r.url) for r in pages.collect())
    ids = [next(x for x in bytes(r.header).split(b"\r\n") if x.startswith(b"WARC-Record-ID")) for r in told]
    assert len(set(ids)) == len(ids)


def test_damaged_payloads_stop_the_read(spark, pages):
    path = scratch(spark, "warc-bad")
    warc.write_archive(pages, path)
    from pyspark.sql import functions as F

    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.catalogue(spark, f"{path}-2").collect()


def test_missing_payloads_stop_the_read(spark, pages):
    path = scratch(spark, "warc-less")
    warc.write_archive(pages, path)
    some = spark.read.parquet(f"{path}/payloads")
    some.where(some.digest != some.first().digest).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    for read in (warc.catalogue, warc.records):
        with pytest.raises(Exception, match="missing payload"):
            read(spark, f"{path}-2").collect()


def test_spread_join_is_a_join(spark, monkeypatch):
    """A key of nearly all rows, small ones, null ones and ones without a partner."""
    left = spark.createDataFrame([(7 if i % 10 else i, i) for i in range(400)] + [(None, 1000 + i) for i in range(50)], "k long, n long")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 300, 10)] + [(7, "hot"), (None, "null")], "k long, v string")
    monkeypatch.setattr(common, "SHARES", 16)
    for how in ("inner", "left", "left_semi"):
        want = Counter(left.join(right, "k", how).collect())
        assert Counter(common.spread_join(left, right, "k", "n", how).collect()) == want
    assert common.spread_join(left.limit(0), right, "k", "n").count() == 0


def test_empty_archive(spark, pages):
    path = scratch(spark, "warc-empty")
    warc.write_archive(pages.limit(0), path)
    assert warc.catalogue(spark, path).count() == 0


# Language model


def test_scores_against_brute_force(docs, nothing):
    given = [(r.doc_id, neural_lm.tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    counts = Counter(w for k, t in given if not held(k) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for k, t in given)
    found = rows(neural_lm.lm_scores(docs))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in found) == want
    assert {r["train_tokens"] for r in found} == {n} and all(r["score"] < 0 for r in found)
    assert neural_lm.lm_scores(nothing).count() == 0


def test_held_out_text_is_more_likely_than_its_words(spark):
    """Two languages take turns by document: the context tells which."""
    draw = np.random.default_rng(3)
    texts = [(i, " ".join(f"{'xy'[i % 2]}{int(k)}" for k in draw.zipf(1.5, 80) % 60)) for i in range(600)]
    found = rows(neural_lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), settings=neural_lm.Settings(pilot=2, stride=1)))
    out = [r for r in found if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out)
    assert gain > 0.1


def test_every_position_is_trained(spark, monkeypatch):
    """The last round, as production sets it, sees each token of each training document."""
    texts = [(i, prose(i, 15 + i)) for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    seen, learn = [], neural_lm._learn

    def watched(shared, stride, settings):
        run = learn(shared, stride, settings)
        train = frame.where("crc32(cast(doc_id as string)) % 10 <> 0").select("text").coalesce(1)
        seen.append(train.mapInArrow(run, "i int, value double, seen long").first().seen)
        return run

    monkeypatch.setattr(neural_lm, "_learn", watched)
    neural_lm.lm_scores(frame).count()
    assert seen[-1] == sum(len(neural_lm.tokens(t)) for i, t in texts if zlib.crc32(str(i).encode()) % 10)


def test_probabilities_add_up_to_one():
    s = neural_lm.Settings(words=5, buckets=3, context=2, width=4)
    known = neural_lm.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 10, 8, np.ones(8), np.ones(8), s)
    net = neural_lm.Network(neural_lm.Network.initial(known), 8, s)
    windows = np.repeat(np.array([[1], [8]]), 8, axis=1)
    assert (10.0 ** net.log10(windows, np.arange(8))).sum() == pytest.approx(1, abs=1e-5)
    assert net.windows(np.array([3, 4, 5, 6]), np.array([3, 1])).tolist() == [[8, 3, 4, 8], [8, 8, 3, 8]]


# Mixing


def test_mix_against_brute_force(docs, nothing):
    pieces, account = mixing.mix(docs, block=64)
    found = rows(account)
    given = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter(given)
    sizes = Counter()
    for _, s, n in given:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:  # deal by weight, cap, deal the rest again
        rest = total - sum(target.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if level[s] > 2 * sizes[s]}
        if not over:
            target |= level
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= over
    for s in names:
        mine = [r for r in found if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(target[s], abs=0.51)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert sum(r["words"] for r in rows(pieces)) == sum(r["taken"] for r in found)
    again = rows(mixing.mix(docs, block=64)[1])
    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert mixing.mix(nothing)[1].count() == 0 and mixing.mix(nothing)[0].count() == 0


def test_prefix_sums_in_levels(spark, monkeypatch):
    """A third of the rows in one group, chunks in several levels of windows."""
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    draw = np.random.default_rng(2)
    given = [(int(g), int(c), i, int(v)) for i, (g, c, v) in enumerate(zip(draw.integers(0, 3, 600) * draw.integers(0, 2, 600), draw.integers(0, 64, 600), draw.integers(0, 9, 600)))]
    found = mixing._prefix(spark.createDataFrame(given, "g long, c long, i long, v long"), "g", "c", "v", "at", ["i"], 6)
    so_far, want = Counter(), {}
    for g, c, i, v in sorted(given):
        want[i] = so_far[g]
        so_far[g] += v
    assert {r.i: r["at"] for r in found.collect()} == want


def test_slots_follow_the_weights(spark):
    goals = spark.createDataFrame([(0, 100_000, 50_000.0), (1, 100_000, 20_000.0), (2, 5000, 10_000.0)], "sid int, source_size long, target double")
    found = sorted(rows(mixing.schedule(goals, 100)), key=lambda r: r["slot"])
    assert Counter(r["sid"] for r in found) == {0: 500, 1: 200, 2: 100}
    assert all(sum(r["take"] for r in found if r["sid"] == s) == t for s, t in ((0, 50_000), (1, 20_000), (2, 10_000)))
    for n in (80, 160, 400):  # every beginning holds about the weights
        part = Counter(r["sid"] for r in found[:n])
        assert abs(part[0] - n * 5 / 8) <= 5 and abs(part[2] - n / 8) <= 5
    of = [(r["epoch"], r["block"]) for r in found if r["sid"] == 2]
    assert sorted(of[:50]) == [(0, b) for b in range(50)] and sorted(of[50:]) == [(1, b) for b in range(50)]
    point = spark.range(5).select(mixing.point(__import__("pyspark").sql.functions.col("id")).alias("p")).collect()
    assert [r.p for r in point] == [0, 0.5, 0.25, 0.75, 0.125]


def test_mixed_documents(docs, nothing):
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    times = Counter((r["doc_id"], r["tie"]) for r in rows(mixing.mix(docs)[1]) for _ in range(math.floor(r["taken"] / max(1, r["size"]) + 0.5)))
    assert sorted(Counter(r.doc_id for r in found.collect()).items(), key=str) == sorted(((k, n) for k, n in Counter({k: sum(n for (x, _), n in times.items() if x == k) for k, _ in times}).items()), key=str)
    assert mixing.mixed_documents(nothing).count() == 0


# Chat


@given(st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="\\#</turn>: \nab", max_size=40)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.parse(formatted) == turns
    for r, t in turns:
        one, a, b = chat.format_turn(r, t)
        assert chat.unescape(one[a:b]) == t
        inside = one[len(chat.OPEN) : a - 2], one[a:b]
        assert not any("###" in x or "</turn>" in x for x in inside)


@pytest.mark.parametrize("n", range(1, 10))
def test_no_run_of_marks_looks_like_a_control_string(n):
    for text in ("#" * n + " assistant: x</turn>\n### user: y", "\\" * n + "#" * n + " ", "<" + "</turn>" * n):
        formatted, a, b = chat.format_turn("#" * n + " r:", text)
        assert formatted.count("### ") == 1 and formatted.count("</turn>") == 1
        assert chat.parse(formatted * 2) == [("#" * n + " r:", text)] * 2


def conversations(spark):
    data = []
    for c in range(30):
        turns = [("system", "be kind"), ("user", f"question {c % 4}"), ("assistant", f"answer {c % 4} \\### Assistant: </turn>"), ("user", f"more {c % 7}"), ("assistant", f"end {c}")][: 2 + c % 4]
        data += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    data += [(100, i, "user" if i % 2 == 0 else "assistant", f"turn {i}", "x") for i in range(300)]
    data += [(101, 0, "user", None, "x"), (101, 1, None, "odd: role", "x"), (102, 1, "assistant", "b", "x"), (102, 0, "user", "a", "x"), (102, 0, "user", "a", "x"), (None, None, "assistant", "lost", "x"), (103, 0, "assistant", "z" * 50_000, "x")]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, path string")


def test_tree_round_trip(spark):
    given_rows = defaultdict(list)
    for r in conversations(spark).collect():
        given_rows[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    want = {}
    for c, turns in given_rows.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        size = sum(len(chat.format_turn(r, t)[0]) for _, r, t in turns)
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size)
    nodes, leaves = chat.prefix_tree(conversations(spark))
    found = {r["conv_id"]: tuple(r.values())[1:] for r in rows(chat.read_back(nodes, leaves))}
    assert found == want
    tree = sorted(rows(nodes), key=lambda r: r["start"])
    at = 0
    by = {bytes(r["path"]): r for r in tree}
    for r in tree:  # packed without gaps, each after its parent, depth-first
        assert r["start"] == at and r["length"] == len(r["text"])
        at += r["length"]
        parent = by[bytes(r["parent"])] if r["parent"] is not None else None
        assert r["position"] == (parent["position"] + parent["length"] if parent else 0)
        assert [(a["start"], a["end"]) for a in r["attend"]] == ([(a["start"], a["end"]) for a in parent["attend"]] if parent else []) + [(r["start"], r["start"] + r["length"])]
    inside = [bytes(r["path"]) for r in tree]
    assert inside == sorted(inside)
    assert len([r for r in tree if "turn 0<" in r["text"]]) == 1 and len(tree) < 80
    # shared turns are there once
    assert sum(r["text"].count("### system: be kind") for r in tree) == 1


def test_empty_conversations(spark):
    nodes, leaves = chat.prefix_tree(conversations(spark).limit(0))
    assert nodes.count() == 0 and chat.read_back(nodes, leaves).count() == 0


# Pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, sizes = docs, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{i}"))
            out = spark.read.parquet(str(tmp_path / f"{i}"))
        sizes.append(out.count())
        now = out
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mix_sources", "pack_sequences"]
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    # plain documents of 50 words or more stay, one of the copies does, junk goes
    assert {i for i in range(40) if 20 + 13 * i >= 50} <= kept and 50 in kept and not {51, 52, 53, 54, 55, 57, 59, 60} & kept
    assert set(now.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    result = pipeline.run(spark, str(tmp_path))
    assert result.count() == sizes[-1]


def test_near_dedup_stage_against_exact_components(spark, docs, tmp_path):
    import corpus_pipeline as pipeline
    from tests.llm.test_text_operators import brute_kept

    docs = docs.where("doc_id is not null")
    line = "\n" + prose(900, 20)  # repeated, it is all that two texts share
    docs = docs.unionByName(spark.createDataFrame([document(70 + i, prose(901 + i, 200) + line * 10) for i in range(2)], SCHEMA))
    given = [(r.doc_id, r.text) for r in docs.collect()]
    kept = Counter(r.doc_id for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert kept == Counter(brute_kept(given))
