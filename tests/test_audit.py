import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

import pytest

from tieout.operators import audit as A
from tieout.operators import audit_tree as T
from tieout.plans.seq import dense_sequence, lag_over


def events(spark, n=50):
    rows = [(i, f"2024-01-{1 + i // 10:02d} 0{i % 10}:00:00", "data_access", f"user-{i % 3}", "read",
             f"res-{i % 4}", '{"k": %d}' % i) for i in range(n)]
    df = spark.createDataFrame(rows, "src_id long, ts string, event_type string, actor string, action string, "
                                     "resource string, details string")
    return df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")


def python_chain(rows, block_rows=A.BLOCK_ROWS):
    prev = A.GENESIS_HASH
    out = []
    for r in rows:
        prev = A.GENESIS_HASH if (r.seq - 1) % block_rows == 0 else prev
        fields = [r.event_id, r.event_type, r.timestamp.strftime("%Y-%m-%dT%H:%M:%S.%f"), r.actor, r.action,
                  r.resource, json.dumps(json.loads(r.details), sort_keys=True, separators=(",", ":"))]
        body = "|".join(f"{len(x)}:{x}" for x in fields)
        h = hashlib.sha256(f"{body}|64:{prev}".encode()).hexdigest()
        out.append((prev, h))
        prev = h
    return out


def test_append_matches_python_and_verifies(spark):
    log, tree = A.audit_append_recorded(events(spark), order_by=["timestamp", "src_id"], block_rows=7, fanout=3)
    log = log.cache()
    assert A.verify(log, block_rows=7, tree=tree).verdict.first().valid is True
    rows = log.orderBy("seq").collect()
    assert [r.event_id for r in rows][:2] == ["AUD-00000001", "AUD-00000002"]
    assert [(r.previous_hash, r.event_hash) for r in rows] == python_chain(rows, 7)
    # append a second batch after the tail: the open block goes on, the next ones start anew
    more, tree = A.audit_append_recorded(events(spark, 20), order_by=["timestamp", "src_id"], tail=log, tree=tree,
                                         block_rows=7, fanout=3)
    first = more.orderBy("seq").first()
    assert first.seq == 51 and first.previous_hash == rows[-1].event_hash
    both = log.unionByName(more).cache()
    assert A.verify(both, block_rows=7, tree=tree, head=tree.head).verdict.first().valid is True
    rows = both.orderBy("seq").collect()
    assert [(r.previous_hash, r.event_hash) for r in rows] == python_chain(rows, 7)
    # one block of seven per leaf; losing a whole block or the end of one shows
    assert tree.nodes.where("level = 0").count() == 10 == A.block_headers(both, 7).count()
    whole = both.filter((F.col("seq") < 15) | (F.col("seq") > 21))
    v = A.verify(whole, block_rows=7, tree=tree).verdict.first()
    assert (v.event_id, v.violation) == ("AUD-00000022", "prev_hash_mismatch")
    v = A.verify(both.filter("seq <> 14"), block_rows=7, tree=tree).verdict.first()
    assert (v.event_id, v.event_index) == ("AUD-00000015", 13)
    last = both.filter("seq < 70")
    assert [r.block for r in T.changed_blocks(last, tree, block_rows=7).collect()] == [9]
    v = A.verify(last, block_rows=7, tree=tree).verdict.first()
    assert (v.valid, v.event_id, v.violation) == (False, "AUD-00000069", "block_mismatch")
    with pytest.raises(ValueError, match="tree"):
        A.verify(both, block_rows=7)
    with pytest.raises(ValueError, match="tree"):
        A.chain_view(both, block_rows=7)


@pytest.mark.parametrize("run_blocks", [1 << 16, 3])
def test_block_headers_chain_over_the_whole_log(spark, run_blocks):
    """Each header covers the header before it, across runs; a purged log's chain starts at its first block."""
    log = A.audit_append(events(spark, 75), order_by=["timestamp", "src_id"], block_rows=7)
    for part in (log, log.where("seq > 30")):
        prev, blocks = "0" * 64, {}
        for r in part.orderBy("seq").collect():
            blocks.setdefault((r.seq - 1) // 7, []).append(r)
        want = []
        for b, rows in sorted(blocks.items()):
            head = f"{b}|{rows[0].seq}|{rows[-1].seq}|{len(rows)}|{rows[-1].event_hash}|{prev}"
            want.append((b, prev, hashlib.sha256(head.encode()).hexdigest()))
            prev = want[-1][2]
        got = A.block_headers(part, 7, run_blocks).orderBy("block").collect()
        assert [(r.block, r.previous_header, r.header_hash) for r in got] == want
    assert A.block_headers(log.where("false"), 7).count() == 0


def recorded(spark, n=50, fanout=2, **options):
    log, tree = A.audit_append_recorded(events(spark, n), order_by=["timestamp", "src_id"], block_rows=7, fanout=fanout,
                                        **options)
    return log.cache(), tree


def python_tree(rows, fanout):
    """{(level, idx): node hash} of a log with blocks of seven."""
    def sha(*parts):
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()
    blocks = {}
    for r in rows:
        blocks.setdefault((r.seq - 1) // 7, []).append(r)
    level = {i: (len(b), sha("leaf", i, b[0].seq, b[-1].seq, len(b), b[-1].event_hash)) for i, b in blocks.items()}
    out, n = {(0, i): h for i, (_, h) in level.items()}, 0
    while n == 0 or len(level) > 1:
        n += 1
        groups = {}
        for i in sorted(level):
            groups.setdefault(i // fanout, []).append(level[i])
        level = {i: (sum(r for r, _ in g), sha("node", n, i, sum(r for r, _ in g), *(h for _, h in g)))
                 for i, g in groups.items()}
        out |= {(n, i): h for i, (_, h) in level.items()}
    return out


def test_plans_of_the_tree_do_not_multiply_with_its_levels(spark, monkeypatch):
    """Tables that a stored plan names: a few per level, not a power of the levels (build, append, purge)."""
    named, store = [], T.stored

    def watched(df, name="part"):
        named.append(df._jdf.queryExecution().analyzed().toString().count("Relation ["))
        return store(df, name)
    monkeypatch.setattr(T, "stored", watched)
    log, tree = recorded(spark, 230)
    more, grown = A.audit_append_recorded(events(spark, 20), order_by=["timestamp", "src_id"], tail=log, tree=tree,
                                          block_rows=7, fanout=2)
    both = log.unionByName(more).cache()
    levels = grown.head.first()["levels"]
    assert levels == 6 and max(named) <= 3 * (levels + 1)
    assert {(r.level, r.idx): r.node_hash for r in grown.nodes.collect()} == python_tree(both.orderBy("seq").collect(), 2)
    p = A.purge(both, retention_days=0, as_of="2024-01-01 00:00:00", tree=grown)
    assert max(named) <= 3 * (levels + 1) and T.broken_nodes(p.tree, grown.head).count() == 0


def test_tree_equals_a_recomputation_and_appends_touch_one_path(spark):
    log, tree = recorded(spark, 100)
    assert {(r.level, r.idx): r.node_hash for r in tree.nodes.collect()} == python_tree(log.orderBy("seq").collect(), 2)
    more, grown = A.audit_append_recorded(events(spark, 9), order_by=["timestamp", "src_id"], tail=log, tree=tree,
                                          block_rows=7, fanout=2)
    both = log.unionByName(more).orderBy("seq").collect()
    now = {(r.level, r.idx): r.node_hash for r in grown.nodes.collect()}
    assert now == python_tree(both, 2)
    old = {(r.level, r.idx): r.node_hash for r in tree.nodes.collect()}
    touched = [k for k in now if now[k] != old.get(k)]
    assert len(touched) <= 3 * (grown.head.first().levels + 1) < len(now)
    # no task holds more than a node's children
    plan = T._parents(tree.nodes.where("level = 0"), 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_block_hashed_anew_is_found(spark):
    log, tree = recorded(spark)
    forged = A.audit_append(log.select("event_type", "timestamp", "actor", "action", "resource", F.col("seq").alias("o"),
                                       F.when(F.col("seq") == 10, "{}").otherwise(F.col("details")).alias("details")),
                            order_by=["o"], block_rows=7).select(A.LOG_COLUMNS).cache()
    for block, event in ((1, "AUD-00000015"), (7, "AUD-00000050")):
        edited = forged if block == 1 else A.audit_append(
            log.select("event_type", "timestamp", "actor", "action", "resource", F.col("seq").alias("o"),
                       F.lit("{}").alias("details")), order_by=["o"], block_rows=7).select(A.LOG_COLUMNS)
        mine = F.floor((F.col("seq") - 1) / 7) == block
        bad = edited.where(mine).unionByName(log.select(A.LOG_COLUMNS).where(~mine))
        v = A.verify(bad, block_rows=7, tree=tree).verdict.first()
        assert (v.valid, v.event_id, v.violation) == (False, event, "block_mismatch")
        assert v.actual != v.expected
        assert [r.event_id for r in A.broken_links(A.chain_view(bad, block_rows=7, tree=tree)).collect()] == [event]
    # rows that nobody recorded, and a log of which nothing is left
    more = A.audit_append(events(spark, 3), order_by=["src_id"], tail=log, block_rows=7)
    assert A.verify(log.unionByName(more), block_rows=7, tree=tree).verdict.first().violation == "block_mismatch"
    v = A.verify(log.where("false"), block_rows=7, tree=tree).verdict.first()
    assert (v.valid, v.event_id, v.violation) == (False, None, "block_mismatch")


def test_a_forged_record_does_not_lead_to_the_head(spark):
    log, tree = recorded(spark)
    forged = A.audit_append(log.select("event_type", "timestamp", "actor", "action", "resource", F.col("seq").alias("o"),
                                       F.lit("{}").alias("details")), order_by=["o"], block_rows=7)
    other = T.build(forged, block_rows=7, fanout=2)
    assert A.verify(forged, block_rows=7, tree=other).verdict.first().valid is True
    v = A.verify(forged, block_rows=7, tree=other, head=tree.head).verdict.first()
    assert (v.valid, v.violation) == (False, "tree_mismatch")
    part = T.AuditTree(tree.nodes.where("level > 0").unionByName(other.nodes.where("level = 0")), tree.head)
    assert {(r.level) for r in T.broken_nodes(part).collect()} == {1}
    nodes = tree.nodes.withColumn("rows", F.when((F.col("level") == 0) & (F.col("idx") == 2), 6).otherwise(F.col("rows")))
    assert {(r.level, r.idx) for r in T.broken_nodes(T.AuditTree(nodes, tree.head)).collect()} >= {(0, 2)}


def test_purge_prunes_the_tree_and_keeps_the_head(spark):
    log, tree = recorded(spark, 100)
    p = A.purge(log, retention_days=0, as_of="2024-01-06 00:00:00", tree=tree)
    anchor = p.anchor.first().anchor_hash
    assert p.log.agg(F.min("seq")).first()[0] == 51 and p.tree.nodes.count() < tree.nodes.count()
    assert p.tree.nodes.where("pruned").count() > 0
    v = A.verify(p.log, anchor_hash=anchor, block_rows=7, tree=p.tree, head=tree.head).verdict.first()
    assert v.valid is True
    v = A.verify(p.log.where("seq <> 70"), anchor_hash=anchor, block_rows=7, tree=p.tree, head=tree.head).verdict.first()
    assert (v.valid, v.event_id) == (False, "AUD-00000071")
    # the log goes on after the purge, and after one that left nothing
    for kept, gone in ((p, None), (A.purge(log, retention_days=0, as_of="2030-01-01 00:00:00", tree=tree), True)):
        more, grown = A.audit_append_recorded(events(spark, 30), order_by=["timestamp", "src_id"], tail=kept.log,
                                              anchor=kept.anchor, tree=kept.tree, block_rows=7, fanout=2)
        left = more if gone else kept.log.unionByName(more)
        assert T.broken_nodes(grown).count() == 0
        v = A.verify(left, anchor_hash=kept.anchor.first().anchor_hash, block_rows=7, tree=grown).verdict.first()
        assert v.valid is True, v


def test_blocks_fold_in_parallel_and_need_no_global_window(spark):
    plan = A.verify(A.audit_append(events(spark), order_by=["timestamp", "src_id"])).rows \
        ._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_null_hashes_are_violations(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"]).cache()
    t = log.withColumn("event_hash", F.when(F.col("seq") < 50, F.col("event_hash")))
    assert A.verify(t).verdict.first().violation == "hash_mismatch"
    t = log.withColumn("previous_hash", F.when(F.col("seq") != 20, F.col("previous_hash")))
    assert A.verify(t).verdict.first().violation == "prev_hash_mismatch"


def test_append_goes_on_after_a_full_purge(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"]).cache()
    p = A.purge(log, retention_days=0, as_of="2030-01-01 00:00:00")
    more = A.audit_append(events(spark, 3), order_by=["timestamp", "src_id"], tail=p.log, anchor=p.anchor)
    first = more.orderBy("seq").first()
    assert first.event_id == "AUD-00000051"
    assert first.previous_hash == log.filter("seq = 50").first().event_hash
    assert A.verify(more, anchor_hash=p.anchor.first().anchor_hash).verdict.first().valid is True


def test_details_hash_in_canonical_form(spark):
    a = events(spark, 3).withColumn("details", F.lit('{"b": [1, {"y": 2, "x": 1}], "a": null}'))
    b = events(spark, 3).withColumn("details", F.lit('{"a":null,"b":[1,{"x":1,"y":2}]}'))
    ha, hb = ([r.event_hash for r in A.audit_append(x, order_by=["src_id"]).orderBy("seq").collect()] for x in (a, b))
    assert ha == hb


def test_export_labels_non_finite_numbers(spark):
    texts = ['{"z": NaN, "deep": [{"v": -Infinity}, Infinity], "text": "a, NaN, b"}', "no json", None]
    log = A.audit_append(events(spark, 3).withColumn("details", F.element_at(
        F.array(*map(F.lit, texts)), (F.col("src_id") + 1).cast("int"))), order_by=["src_id"])
    got = [json.loads(r.json)["details"] for r in A.export_json(log.orderBy("seq")).collect()]
    assert got == [{"z": "NaN", "deep": [{"v": "-Infinity"}, "Infinity"], "text": "a, NaN, b"}, "no json", {}]


def test_tampering_is_located(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"]).cache()
    t = log.withColumn("details", F.when(F.col("seq") == 5, F.lit("{}")).otherwise(F.col("details")))
    v = A.verify(t).verdict.first()
    assert (v.valid, v.event_index, v.event_id, v.violation) == (False, 4, "AUD-00000005", "hash_mismatch")
    v = A.verify(log.filter(F.col("seq") != 10)).verdict.first()
    assert (v.event_id, v.violation) == ("AUD-00000011", "prev_hash_mismatch")
    view = A.chain_view(log.filter(F.col("seq") != 10))
    assert [r.event_id for r in A.broken_links(view).collect()] == ["AUD-00000011"]


def test_purge_keeps_chain_verifiable(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"]).cache()
    p = A.purge(log, retention_days=0, as_of="2024-01-03 00:00:00")
    anchor = p.anchor.first().anchor_hash
    kept = p.log.orderBy("seq").collect()
    assert kept[0].seq == 21 and anchor == log.filter(F.col("seq") == 20).first().event_hash
    assert A.verify(p.log, anchor_hash=anchor).verdict.first().valid is True
    assert A.verify(p.log).verdict.first().valid is False  # genesis no longer applies


def test_parallel_chains(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"], chain_by="actor").cache()
    assert A.verify(log, chain_by="actor").verdict.first().valid is True
    t = log.withColumn("details", F.when(F.col("seq") == 30, F.lit("{}")).otherwise(F.col("details")))
    assert A.verify(t, chain_by="actor").verdict.first().event_id == "AUD-00000030"
    small, tree = recorded(spark, 52, chain_by="actor")
    assert A.verify(small, chain_by="actor", block_rows=7, tree=tree).verdict.first().valid is True
    more, tree = A.audit_append_recorded(events(spark, 2), order_by=["src_id"], tail=small, tree=tree, chain_by="actor",
                                         block_rows=7, fanout=2)
    both = small.unionByName(more)
    assert A.verify(both, chain_by="actor", block_rows=7, tree=tree).verdict.first().valid is True
    assert A.verify(both.where("seq < 50"), chain_by="actor", block_rows=7, tree=tree).verdict.first().valid is False
    for actor in ("user-0", "user-1", "user-2"):
        part = log.filter(F.col("actor") == actor).orderBy("seq").collect()
        assert part[0].previous_hash == A.GENESIS_HASH
        assert all(a.event_hash == b.previous_hash for a, b in zip(part, part[1:]))


def test_query_and_export(spark):
    log = A.audit_append(events(spark), order_by=["timestamp", "src_id"])
    q = A.query(log, actor="user-1", start="2024-01-02 00:00:00", end="2024-01-02 09:00:00")
    assert q.count() == 4  # ids 10, 13, 16, 19; the 09:00 end bound is inclusive
    js = A.export_json(log).first().json
    assert '"details":{"k":0}' in js and '"event_id":"AUD-00000001"' in js


def test_lag_over_equals_global_lag(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"), F.col("id").cast("string").alias("v"))
    df = df.filter(F.col("k") % 11 != 3)  # gaps
    got = {r.k: r.lag_value for r in lag_over(df, "k", "v", num_partitions=6).collect()}
    want = {r.k: r.lv for r in df.select("k", F.lag("v").over(Window.orderBy("k")).alias("lv")).collect()}
    assert got == want


def test_dense_sequence(spark):
    df = spark.range(0, 1000).select((F.col("id") * 13 % 1009).alias("k"))
    rows = dense_sequence(df, ["k"], num_partitions=5).collect()
    assert sorted((r.k, r.seq) for r in rows) == list(zip(sorted(r.k for r in rows), range(1, 1001)))


def test_parallel_chains_continue_from_the_tail(spark):
    first = A.audit_append(events(spark, 30), order_by=["timestamp", "src_id"], chain_by="actor").cache()
    more = events(spark, 60).filter(F.col("src_id") >= 30)
    second = A.audit_append(more, order_by=["timestamp", "src_id"], chain_by="actor", tail=first).cache()
    heads = {r.actor: r.event_hash for r in
             first.groupBy("actor").agg(F.max_by("event_hash", "seq").alias("event_hash")).collect()}
    starts = {r.actor: r.previous_hash for r in
              second.groupBy("actor").agg(F.min_by("previous_hash", "seq").alias("previous_hash")).collect()}
    assert starts == heads
    assert second.agg(F.min("seq")).first()[0] == 31
