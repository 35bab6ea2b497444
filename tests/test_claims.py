"""Claims as a table and as a stream against a reader that goes through the facts one by one."""

import random

from pyspark.sql import functions as F

from weftline import tables
from weftline.functions import text
from weftline.operators import claims, graph
from weftline.plans.model import Pattern
from weftline.streaming import claims as claim_stream

SHAPE = "run_id long, event_id string, subject string, relation string, object string, stream_position long, window_index long"
PLAN = (
    Pattern("A", "Start", "leads to", "?x", aliases={"subject": ("The Start",)}), Pattern("B", "?x", "leads to", "?y"), Pattern("C", "?z", "knows", "?y"), Pattern("D", "?z", "knows", "?x"),
    Pattern("E", "?y", "ends at", "End"), Pattern("F", "?w", "is", "?w"),
)


def read_one_by_one(facts, defer=True):
    """(run, event, pattern) -> (status, bound_at, committed_at, distance)."""
    norm = lambda s: None if s is None else " ".join(s.lower().strip(" \"'").split())
    known, waiting, out = {}, [], {}

    def commit(f, p, since):
        run, event, s, _, o, at, window = f
        when = max((at, window), since) if since else (at, window)
        out[run, event, p.id] = ("PROMOTED" if since and since > (at, window) else "DIRECT", since and since[0], when[0], max(since[1] - window, 0) if since else 0)
        for end, value in ((p.subject, s), (p.object, o)):
            if end.startswith("?") and value is not None and (run, end, norm(value)) not in known:
                known[run, end, norm(value)] = when
                now = [w for w in waiting if w[0][0] == run and any(e == end and norm(v) == norm(value) for e, v in ((w[1].subject, w[0][2]), (w[1].object, w[0][4])))]
                for w in now:
                    if w in waiting:
                        waiting.remove(w)
                        commit(*w, when)

    for f in sorted(facts, key=lambda f: (f[5], f[1])):
        run, event, s, relation, o, at, window = f
        fit = 0
        for p in PLAN:
            names = lambda end, p=p: [norm(n) for n in (getattr(p, end), *p.aliases.get(end, ()))]
            if norm(relation) != p.relation or any(not getattr(p, end).startswith("?") and norm(v) not in names(end) for end, v in (("subject", s), ("object", o))):
                continue
            if p.subject == p.object and (s is None or norm(s) != norm(o)):
                continue
            fit += 1
            ends = [(run, e, norm(v)) for e, v in ((p.subject, s), (p.object, o)) if v is not None]
            since = min((known[e] for e in ends if e in known), default=None)
            if not (p.subject.startswith("?") and p.object.startswith("?")):
                commit(f, p, None)
            elif since is not None:
                commit(f, p, since)
            else:
                out[run, event, p.id] = ("DEFERRED" if defer else "SKIPPED", None, None, None)
                if defer:
                    waiting.append((f, p))
        if not fit:
            out[run, event, None] = ("SKIPPED", None, None, None)
    return out


def some_facts(n=160, seed=7):
    rng, names = random.Random(seed), [f"n{k}" for k in range(25)]
    spelt = lambda v: None if v is None else rng.choice([v, v.upper(), f' "{v}"', v + "  "])
    out = []
    for k in range(n):
        at = rng.randrange(100)
        s, o = rng.choice([*names, None]), rng.choice([*names, None])
        r = rng.choice(["leads to", "Leads  to", "knows", "knows", "ends at", "is", "nothing", None])
        if r == "ends at":
            o = rng.choice(["END", "n1"])
        if r == "is" and rng.random() < 0.7:
            o = s
        if rng.random() < 0.06:
            s, r = rng.choice(["start", "the start"]), "leads to"
        out.append((rng.randrange(3), f"e{k}", spelt(s), r, spelt(o), at, at // 10))
    return out


def final(rows):
    got = {}
    for r in rows:
        key = (r.run_id, r.event_id, r.pattern_id)
        if key not in got or got[key][0] == "DEFERRED":
            got[key] = (r.status, r.bound_at, r.committed_at, r.distance)
        else:
            assert r.status == "DEFERRED"
    return got


def test_settle(spark):
    facts = some_facts()
    df, patterns = spark.createDataFrame(facts, SHAPE), claims.pattern_table(spark, PLAN)
    for defer in (True, False):
        rows = claims.settle(df, patterns, defer).collect()
        assert final(rows) == read_one_by_one(facts, defer) and len(rows) == len(final(rows))
    assert {s[0] for s in read_one_by_one(facts).values()} == {"DIRECT", "PROMOTED", "DEFERRED", "SKIPPED"}
    assert claims.settle(df.limit(0), patterns).collect() == []
    assert {r.status for r in claims.settle(df, patterns.limit(0)).collect()} == {"SKIPPED"}
    # each run with its own plan: the run without one skips all
    own = patterns.crossJoin(spark.createDataFrame([(0,), (2,)], "run_id long"))
    assert final(claims.settle(df, own).collect()) == {k: v for k, v in read_one_by_one(facts).items() if k[0] != 1} | {(1, f[1], None): ("SKIPPED", None, None, None) for f in facts if f[0] == 1}


def test_runs_within_a_row_and_by_rounds(spark, monkeypatch):
    """Both ways give the same; the first stores nothing but the list of long runs and deals the facts once."""
    plan = claims.pattern_table(spark, PLAN)
    facts = some_facts(seed=23) + [(None, "n1", "a", "based in", "b", 1, 0), (1, "n2", "a", "based in", "b", None, None)]
    df = spark.createDataFrame(facts, SHAPE)
    kept = []
    monkeypatch.setattr(claims, "stored", lambda df, tag: kept.append(tag) or tables.stored(df, tag))
    for defer in (True, False):
        got = {}
        for most in (10**6, 0, len([f for f in facts if f[0] == 1]) - 1):
            monkeypatch.setattr(claims, "MOST_IN_ROW", most)
            kept.clear()
            got[most] = sorted(map(repr, claims.settle(df, plan, defer).collect()))
            assert (set(kept) == {"runs"}) == (most == 10**6)
        assert len(set(map(tuple, got.values()))) == 1, defer
    monkeypatch.setattr(claims, "MOST_IN_ROW", 10**6)
    settled = claims.settle(df, plan)
    shown = claims.bindings_then_and_now(settled, plan)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Union") == 0 and shown.count("known(") == 1, shown


def test_stream_and_its_state(spark, tmp_path):
    """Four parts, the query stopped after each; repeated events; and the state that is left, read from the checkpoint."""
    facts = some_facts(seed=11)
    patterns = claims.pattern_table(spark, PLAN)
    claim_stream.use_map_state(spark)
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
    for low in (0, 25, 50, 75):
        part = [f for f in facts if low <= f[5] < low + 25] + [f for f in facts if f[5] < low][:9]
        spark.createDataFrame(part, SHAPE).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        q = claim_stream.follow(live, patterns).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    want = read_one_by_one(facts)
    assert final(rows) == want
    snapshot = claim_stream.snapshot(spark, f"{tmp_path}/state")
    waits = {(r.run_id, r.event_id, r.pattern_id) for r in snapshot["waiting"].collect()}
    assert waits == {k for k, v in want.items() if v[0] == "DEFERRED"}
    known = {(r.run_id, r.variable, r.value): r.since for r in snapshot["known"].collect()}
    table = claims.known_values(claims.matches(spark.createDataFrame(facts, SHAPE), patterns))
    assert known == {(r.run_id, r["var"], r.key): r.since["at"] for r in table.collect()}
    # a snapshot of an earlier batch is what the facts up to it give
    early = [f for f in facts if f[5] < 50]
    before = claim_stream.snapshot(spark, f"{tmp_path}/state", batch=1)
    assert {(r.run_id, r.event_id, r.pattern_id) for r in before["waiting"].collect()} == {k for k, v in read_one_by_one(early).items() if v[0] == "DEFERRED"}


def test_versions(spark):
    plan = claims.pattern_table(spark, (Pattern("P", "Film", "director", "?d"), Pattern("Q", "?d", "born", "?y")))
    facts = [(1, "e1", "film", "director", "Ann", 1, 0), (1, "e2", "film", "director", "Bob", 2, 0), (1, "e3", "BOB", "born", "1950", 0, 0), (1, "e4", "ann", "born", "1960", 5, 1), (1, "e5", "bob", "born", "1951", 6, 1), (1, "e6", "eve", "born", "1970", 7, 1)]
    settled = claims.settle(spark.createDataFrame(facts, SHAPE), plan)
    got = {(r.variable, r.version): (r.value, r.previous, r.valid_from, r.valid_to, r.event_id) for r in claims.versions(settled, plan).collect()}
    assert got == {
        ("?d", 1): ("Ann", None, 1, 2, "e1"), ("?d", 2): ("BOB", "Ann", 2, 5, "e3"), ("?d", 3): ("ann", "BOB", 5, 6, "e4"), ("?d", 4): ("bob", "ann", 6, None, "e5"),
        ("?y", 1): ("1950", None, 2, 5, "e3"), ("?y", 2): ("1960", "1950", 5, 6, "e4"), ("?y", 3): ("1951", "1960", 6, None, "e5"),
    }
    then = {(r.event_id, r.variable): (r.value, r.bound_then, r.bound_now) for r in claims.bindings_then_and_now(settled, plan).collect()}
    assert then["e2", "?d"] == ("Bob", "Ann", "bob") and then["e4", "?y"] == ("1960", "1960", "1951") and len(then) == 8, then


def test_long_paths_are_followed_to_their_end(spark):
    chain = [(1, k, f"?v{k}", f"?v{k + 1}", True, "ACTIVE" if k == 21 else "SATISFIED") for k in range(22)]
    circle = [(2, k, f"?v{k}", f"?v{(k + 1) % 5}", True, "ACTIVE" if k == 3 else "CONFLICTED") for k in range(5)]
    df = spark.createDataFrame(chain + circle, "run_id long, edge_id long, subject string, object string, required boolean, state string")
    got = {(r.run_id, r.edge_id): r.open for r in graph.open_descendants(df).collect()}
    assert got == {(1, k): k < 21 for k in range(22)} | {(2, k): k != 3 for k in range(5)}
    wide = spark.createDataFrame([(k, k + 1) for k in range(80)], "a long, b long")
    assert {r.component for r in graph.components(wide, "a", "b").collect()} == {0}


def test_quoted_names(spark):
    rows = spark.createDataFrame([('"Film A (1990 film)"', "film a", "who made Film A here?"), (" 'X (y)' ", "x", "is X it?")], "v string, w string, q string")
    got = rows.select(text.alias_score_udf("v", "w").alias("s"), text.question_anchor_udf("v", "q").alias("a"), text.entity_key(F.col("v")).alias("k")).collect()
    assert [(r.s, r.a, r.k) for r in got] == [(1.5, "Film A", "film a"), (1.5, "X", "x")]
