"""Layer 1: key-based record matching with duplicate isolation.

Plan (``strategy="aggregate"``, the default at every size):

1. Both sides are tagged and unioned; each row carries its normalised,
   null-safe key columns and its own record struct.
2. ONE ``groupBy(key)`` computes per-key side counts and the first record of
   each side (``min`` of the record, or ``min_by`` over an explicit
   ``order_by``). The aggregation is
   partial on the map side, so a hot key (blank ids, a mass duplicate) is
   collapsed before the shuffle and never lands whole in one task.
3. Keys that are unambiguous (<= 1 row per side) emit their result straight
   from the aggregate row: matched / conflict / unmatched_*.
4. Rows under ambiguous keys are emitted by joining the tagged input back to
   the (usually small) ambiguous-key table. AQE picks broadcast or
   sort-merge at runtime and splits a skewed key's partition.

NULL key parts match each other (as Python ``None == None``): grouping and
the join use a (value-with-default, is-null) pair per part, so plain
equality behaves like ``<=>`` and the exchange stays on plain columns.

``strategy="window"`` is the single-shuffle alternative (one window over the
key) for callers who know that no key is hot: it avoids the second scan but
cannot split a key. The rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import check_key_types, key_columns, normalize_key, null_safe_parts

# fixed values: match statuses
MATCHED = "matched"
UNMATCHED_SOURCE = "unmatched_source"
UNMATCHED_TARGET = "unmatched_target"
DUPLICATE = "duplicate"
CONFLICT = "conflict"
STATUSES = (MATCHED, UNMATCHED_SOURCE, UNMATCHED_TARGET, DUPLICATE, CONFLICT)

CONFLICT_TYPE = T.ArrayType(T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("source_value", T.StringType()),
    T.StructField("target_value", T.StringType()),
]))


def _field_of(rec: Column, schema_names: set[str], name: str) -> Column:
    return rec.getField(name) if name in schema_names else F.lit(None)


def _differs(sv: Column, tv: Column, st: T.DataType | None, tt: T.DataType | None) -> Column:
    """Python ``sv != tv``: None equals None, None differs from any value,
    NaN differs from everything (Spark's ``<=>`` treats NaN = NaN)."""
    if st is None and tt is None:
        return F.lit(False)
    if st is None or tt is None:
        present = tv if st is None else sv
        return present.isNotNull()
    s_num, t_num = isinstance(st, T.NumericType), isinstance(tt, T.NumericType)
    if type(st) is not type(tt) and not (s_num and t_num):
        # different kinds ('1' vs 1) never compare equal in Python
        return ~(sv.isNull() & tv.isNull())
    cond = ~sv.eqNullSafe(tv)
    if isinstance(st, (T.DoubleType, T.FloatType)):
        cond = cond | F.coalesce(F.isnan(sv), F.lit(False))
    if isinstance(tt, (T.DoubleType, T.FloatType)):
        cond = cond | F.coalesce(F.isnan(tv), F.lit(False))
    return cond


def conflict_array(s_rec: Column, t_rec: Column, source_schema: T.StructType,
                   target_schema: T.StructType, value_fields: list[str]) -> Column:
    """array<struct<field, source_value, target_value>> of differing fields."""
    if not value_fields:
        return F.array().cast(CONFLICT_TYPE)
    s_names = {f.name: f.dataType for f in source_schema.fields}
    t_names = {f.name: f.dataType for f in target_schema.fields}
    items = []
    for vf in value_fields:
        sv = _field_of(s_rec, set(s_names), vf)
        tv = _field_of(t_rec, set(t_names), vf)
        cond = _differs(sv, tv, s_names.get(vf), t_names.get(vf))
        items.append(F.when(cond, F.struct(
            F.lit(vf).alias("field"),
            sv.cast("string").alias("source_value"),
            tv.cast("string").alias("target_value"))))
    return F.array_compact(F.array(*items)).cast(CONFLICT_TYPE)


def _order_struct_check(df: DataFrame) -> None:
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            raise ValueError(f"column {f.name!r} is not orderable; pass order_by")


def _order_struct(df: DataFrame, order_by: list[str] | None) -> Column:
    cols = order_by or df.columns
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"order_by columns {missing} not in {df.columns}")
    for c in cols:
        if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):
            raise ValueError(f"column {c!r} is not orderable; pass order_by")
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in cols])


def _tagged(source: DataFrame, target: DataFrame, key_fields: list[str],
            normalize_keys: bool, order_by: list[str] | None) -> tuple[DataFrame, list[str]]:
    ktypes = check_key_types(source, target, key_fields)
    s_type = T.StructType(source.schema.fields)
    t_type = T.StructType(target.schema.fields)

    def side(df: DataFrame, is_src: bool) -> DataFrame:
        parts = []
        for i, (c, dt) in enumerate(zip(key_columns(df, key_fields, normalize_keys), ktypes)):
            parts += null_safe_parts(c, dt, f"_k{i}")
        rec = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
        s_rec = rec if is_src else F.lit(None).cast(s_type)
        t_rec = F.lit(None).cast(t_type) if is_src else rec
        cols = [*parts, F.lit(is_src).alias("_is_src"), s_rec.alias("_src_rec"), t_rec.alias("_tgt_rec")]
        if order_by:  # without an explicit order the record orders itself: no ordering columns needed
            ordc = _order_struct(df, order_by)
            cols += [(ordc if is_src else F.lit(None).cast(s_ord_type)).alias("_src_ord"),
                     (F.lit(None).cast(t_ord_type) if is_src else ordc).alias("_tgt_ord")]
        return df.select(*cols)

    if order_by:
        s_ord_type = source.select(_order_struct(source, order_by).alias("o")).schema["o"].dataType
        t_ord_type = target.select(_order_struct(target, order_by).alias("o")).schema["o"].dataType
    else:
        for df in (source, target):  # the record itself is the ordering: it must be orderable
            _order_struct_check(df)
    s = side(source, True)
    t = side(target, False)
    kcols = [f"_k{i}_{x}" for i in range(len(key_fields)) for x in ("v", "n")]
    return s.unionByName(t), kcols


def _first_of(rec: str, ordering: str, order_by: list[str] | None) -> Column:
    """First record of a side under a key. Without an explicit order the
    record orders itself, so ``min(rec)`` gives the same row as
    ``min_by(rec, rec)`` with half the aggregation buffer."""
    return F.min(rec) if not order_by else F.min_by(rec, ordering)


def _key_struct(key_fields: list[str]) -> Column:
    return F.struct(*[
        F.when(F.col(f"_k{i}_n"), F.lit(None)).otherwise(F.col(f"_k{i}_v")).alias(f)
        for i, f in enumerate(key_fields)])


def match(source: DataFrame, target: DataFrame, key_fields: list[str],
          value_fields: list[str] | None = None, *, normalize_keys: bool = True,
          order_by: list[str] | None = None, strategy: str = "aggregate") -> DataFrame:
    """Match two record sets; one result row per input row except that a
    clean 1:1 pair yields one row.

    Columns: status, origin ('source' | 'target' | 'pair'), source_key,
    target_key, source_record, target_record, conflicts.
    ``order_by`` picks the "first" record of a side under an ambiguous key
    (default: all columns of that side).
    ``strategy``: "aggregate" (skew-safe) or "window" (one shuffle, no hot keys).
    """
    if not key_fields:
        raise ValueError("key_fields must not be empty")
    if strategy not in ("aggregate", "window"):
        raise ValueError("strategy must be 'aggregate' or 'window'")
    value_fields = list(value_fields or [])
    u, kcols = _tagged(source, target, key_fields, normalize_keys, order_by)
    key = _key_struct(key_fields)
    conf = conflict_array(F.col("_s1"), F.col("_t1"), source.schema, target.schema, value_fields)
    empty = F.array().cast(CONFLICT_TYPE)

    if strategy == "window":
        w = Window.partitionBy(*kcols)
        scored = u.select(
            "*",
            F.count_if(F.col("_is_src")).over(w).alias("_ns"),
            F.count_if(~F.col("_is_src")).over(w).alias("_nt"),
            _first_of("_src_rec", "_src_ord", order_by).over(w).alias("_s1"),
            _first_of("_tgt_rec", "_tgt_ord", order_by).over(w).alias("_t1"))
        dup = (F.col("_ns") > 1) | (F.col("_nt") > 1)
        pair = (F.col("_ns") == 1) & (F.col("_nt") == 1)
        # the target copy of a 1:1 pair is dropped; the source copy speaks for both
        kept = scored.filter(dup | ~pair | F.col("_is_src"))
        return kept.select(
            F.when(dup, DUPLICATE).when(pair, F.when(F.size(conf) > 0, CONFLICT).otherwise(MATCHED))
             .when(F.col("_is_src"), UNMATCHED_SOURCE).otherwise(UNMATCHED_TARGET).alias("status"),
            F.when(pair & ~dup, "pair").when(F.col("_is_src"), "source").otherwise("target").alias("origin"),
            F.when(F.col("_ns") > 0, key).alias("source_key"),
            F.when(F.col("_nt") > 0, key).alias("target_key"),
            F.when(F.col("_is_src"), F.col("_src_rec")).otherwise(F.col("_s1")).alias("source_record"),
            F.when(~F.col("_is_src"), F.col("_tgt_rec")).otherwise(F.col("_t1")).alias("target_record"),
            F.when(pair & ~dup, conf).otherwise(empty).alias("conflicts"))

    stats = _key_stats(u, kcols, order_by)

    single = stats.filter((F.col("_ns") <= 1) & (F.col("_nt") <= 1))
    pair = (F.col("_ns") == 1) & (F.col("_nt") == 1)
    clean = single.select(
        F.when(pair, F.when(F.size(conf) > 0, CONFLICT).otherwise(MATCHED))
         .when(F.col("_ns") == 1, UNMATCHED_SOURCE).otherwise(UNMATCHED_TARGET).alias("status"),
        F.when(pair, "pair").when(F.col("_ns") == 1, "source").otherwise("target").alias("origin"),
        F.when(F.col("_ns") > 0, key).alias("source_key"),
        F.when(F.col("_nt") > 0, key).alias("target_key"),
        F.col("_s1").alias("source_record"),
        F.col("_t1").alias("target_record"),
        F.when(pair, conf).otherwise(empty).alias("conflicts"))

    ambiguous = stats.filter((F.col("_ns") > 1) | (F.col("_nt") > 1))
    dups = u.drop(*[c for c in ("_src_ord", "_tgt_ord") if c in u.columns]).join(ambiguous, on=kcols,
                                                                                   how="inner").select(
        F.lit(DUPLICATE).alias("status"),
        F.when(F.col("_is_src"), "source").otherwise("target").alias("origin"),
        F.when(F.col("_ns") > 0, key).alias("source_key"),
        F.when(F.col("_nt") > 0, key).alias("target_key"),
        F.when(F.col("_is_src"), F.col("_src_rec")).otherwise(F.col("_s1")).alias("source_record"),
        F.when(~F.col("_is_src"), F.col("_tgt_rec")).otherwise(F.col("_t1")).alias("target_record"),
        empty.alias("conflicts"))
    return clean.unionByName(dups)


def _key_stats(u: DataFrame, kcols: list[str], order_by: list[str] | None) -> DataFrame:
    """The one per-key aggregate everything else derives from."""
    return u.groupBy(*kcols).agg(
        F.count_if(F.col("_is_src")).alias("_ns"),
        F.count_if(~F.col("_is_src")).alias("_nt"),
        _first_of("_src_rec", "_src_ord", order_by).alias("_s1"),
        _first_of("_tgt_rec", "_tgt_ord", order_by).alias("_t1"))


def _slim_stats(source: DataFrame, target: DataFrame, key_fields: list[str], value_fields: list[str],
                normalize_keys: bool) -> tuple[DataFrame, Column]:
    """Per key: the row count of each side and, for the one row of a pair,
    each side's values (a maximum over one row). Only keys and value fields
    are read, and the buffers are plain values, so Spark plans a hash
    aggregate for fixed-width values. Also: whether a pair's values differ."""
    ktypes = check_key_types(source, target, key_fields)
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (source, target)]

    def side(df: DataFrame, is_src: bool) -> DataFrame:
        parts = []
        for i, (c, dt) in enumerate(zip(key_columns(df, key_fields, normalize_keys), ktypes)):
            parts += null_safe_parts(c, dt, f"_k{i}")
        for i, v in enumerate(value_fields):
            for mine, tag in ((is_src, "s"), (not is_src, "t")):
                dt = types[0 if tag == "s" else 1].get(v, T.StringType())
                own = F.col(f"`{v}`") if mine and v in df.columns else F.lit(None).cast(dt)
                parts.append(own.alias(f"_{tag}{i}"))
        return df.select(*parts, F.lit(int(is_src)).alias("_is_src"))

    u = side(source, True).unionByName(side(target, False))
    kcols = [f"_k{i}_{x}" for i in range(len(key_fields)) for x in ("v", "n")]
    st = u.groupBy(*kcols).agg(
        F.sum("_is_src").alias("_ns"), (F.count(F.lit(1)) - F.sum("_is_src")).alias("_nt"),
        *(F.max(f"_{tag}{i}").alias(f"_{tag}{i}") for i in range(len(value_fields)) for tag in "st"))
    differs = F.lit(False)
    for i, v in enumerate(value_fields):
        differs = differs | _differs(F.col(f"_s{i}"), F.col(f"_t{i}"), types[0].get(v), types[1].get(v))
    return st, differs


def match_summary(source: DataFrame, target: DataFrame, key_fields: list[str],
                  value_fields: list[str] | None = None, *, normalize_keys: bool = True) -> DataFrame:
    """``match_report`` without producing the result rows: every count
    follows from the per-key aggregate (an ambiguous key contributes
    ns + nt duplicate rows), so the report costs one shuffle and no second
    pass over the inputs. Same columns and values as
    ``match_report(match(...))``."""
    if not key_fields:
        raise ValueError("key_fields must not be empty")
    value_fields = list(value_fields or [])
    st, differs = _slim_stats(source, target, key_fields, value_fields, normalize_keys)
    ns, nt = F.col("_ns"), F.col("_nt")
    pair = (ns == 1) & (nt == 1)
    dup = (ns > 1) | (nt > 1)
    conflict = pair & differs
    agg = st.agg(
        F.coalesce(F.sum(ns), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum(nt), F.lit(0)).alias("target_count"),
        F.count_if(pair).alias("matched_count"),
        F.count_if((ns == 1) & (nt == 0)).alias("unmatched_source_count"),
        F.count_if((ns == 0) & (nt == 1)).alias("unmatched_target_count"),
        F.count_if(conflict).alias("conflict_count"),
        F.coalesce(F.sum(F.when(dup, ns + nt)), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum(F.when(dup, ns + nt).otherwise(F.lit(1))), F.lit(0)).alias("result_count"))
    return agg.select(
        "source_count", "target_count", "matched_count", "unmatched_source_count", "unmatched_target_count",
        "conflict_count", "duplicate_count", "result_count",
        F.when(F.col("source_count") > 0, F.col("matched_count") / F.col("source_count"))
         .otherwise(F.lit(0.0)).alias("match_rate"),
        (F.col("matched_count") - F.col("conflict_count") == F.col("result_count")).alias("is_fully_reconciled"))


def key_side_counts(source: DataFrame, target: DataFrame, key_fields: list[str],
                    *, normalize_keys: bool = True) -> DataFrame:
    """Per normalised key: rows on each side and whether it is ambiguous
    (agg_duplicate_keys). One partial aggregate, no join."""
    ktypes = check_key_types(source, target, key_fields)

    def side(df: DataFrame, is_src: bool) -> DataFrame:
        cols = [c.alias(f) for c, f in zip(key_columns(df, key_fields, normalize_keys), key_fields)]
        return df.select(*cols, F.lit(is_src).alias("_is_src"))

    s, t = side(source, True), side(target, False)
    for f, dt in zip(key_fields, ktypes):
        s = s.withColumn(f, F.col(f).cast(dt))
        t = t.withColumn(f, F.col(f).cast(dt))
    u = s.unionByName(t)
    # groupBy treats NULLs as one group, like Python's None == None
    return u.groupBy(*key_fields).agg(
        F.count_if(F.col("_is_src")).alias("n_source"),
        F.count_if(~F.col("_is_src")).alias("n_target")) \
        .withColumn("is_duplicate", (F.col("n_source") > 1) | (F.col("n_target") > 1))


def match_report(results: DataFrame) -> DataFrame:
    """One-row report. ``source_count`` counts input source rows (origin
    source or pair), not result rows, so target-side duplicates never
    inflate the match-rate denominator."""
    st = F.col("status")
    agg = results.agg(
        F.count_if(F.col("origin").isin("source", "pair")).alias("source_count"),
        F.count_if(F.col("origin").isin("target", "pair")).alias("target_count"),
        F.count_if(st.isin(MATCHED, CONFLICT)).alias("matched_count"),
        F.count_if(st == UNMATCHED_SOURCE).alias("unmatched_source_count"),
        F.count_if(st == UNMATCHED_TARGET).alias("unmatched_target_count"),
        F.count_if(st == CONFLICT).alias("conflict_count"),
        F.count_if(st == DUPLICATE).alias("duplicate_count"),
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(st == MATCHED).alias("_clean"))
    return agg.select(
        "source_count", "target_count", "matched_count", "unmatched_source_count",
        "unmatched_target_count", "conflict_count", "duplicate_count", "result_count",
        F.when(F.col("source_count") > 0, F.col("matched_count") / F.col("source_count"))
         .otherwise(F.lit(0.0)).alias("match_rate"),
        (F.col("_clean") == F.col("result_count")).alias("is_fully_reconciled"))


# ------------------------------------------------------------------ three-way
THREE_WAY_CATEGORIES = {
    # fixed values: category -> severity, as the reference assigns them
    "LEDGER_ONLY_TRUTH": "high",
    "WAREHOUSE_MISSING": "medium",
    "PROCESSOR_MISSING": "high",
    "WAREHOUSE_DRIFT": "low",
    "PROCESSOR_DRIFT": "high",
}


def three_way_key_stats(gl: DataFrame, proc: DataFrame, wh: DataFrame, *,
                        key: str = "txn_id", amount: str = "amount",
                        normalize_keys: bool = True) -> DataFrame:
    """One union-tag aggregate over the three systems: per normalised key the
    row count of each side plus that side's first raw key and amount."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        k = F.col(key)
        nk = normalize_key(k) if normalize_keys and isinstance(df.schema[key].dataType, T.StringType) else k
        return df.select(nk.alias("_k"), F.lit(tag).alias("_side"),
                         F.struct(k.alias("raw"), F.col(amount).cast("double").alias("amount")).alias("_rec"))

    u = side(gl, "g").unionByName(side(proc, "p")).unionByName(side(wh, "w"))
    aggs = []
    for tag in ("g", "p", "w"):
        is_t = F.col("_side") == tag
        aggs += [F.count_if(is_t).alias(f"n_{tag}"),
                 F.min_by("_rec", F.when(is_t, F.col("_rec"))).alias(f"r_{tag}")]
    return u.groupBy("_k").agg(*aggs)


def _amount_differs(a: Column, b: Column) -> Column:
    return _differs(a, b, T.DoubleType(), T.DoubleType())


def three_way_classify(stats: DataFrame) -> DataFrame:
    """Exceptions per key (a key can yield several rows).

    Pairwise semantics of the reference: a key ambiguous in one pair drops
    out of that pair only; GL-side ids are reported raw.
    """
    ng, np_, nw = F.col("n_g"), F.col("n_p"), F.col("n_w")
    ga, pa, wa = F.col("r_g.amount"), F.col("r_p.amount"), F.col("r_w.amount")
    miss_p = (ng == 1) & (np_ == 0)
    miss_w = (ng == 1) & (nw == 0)

    def issue(cond: Column, cat: str, evidence: Column) -> Column:
        return F.when(cond, F.struct(F.lit(cat).alias("category"), evidence.alias("evidence"),
                                     F.lit(THREE_WAY_CATEGORIES[cat]).alias("severity")))

    def drift_text(label: str, other: Column) -> Column:
        return F.format_string(f"GL=%.2f vs {label}=%.2f (Δ=%+.2f)", ga, other, other - ga)

    issues = F.array_compact(F.array(
        issue(miss_p & miss_w, "LEDGER_ONLY_TRUTH",
              F.lit("present in GL but absent from processor AND warehouse")),
        issue(miss_w & ~miss_p, "WAREHOUSE_MISSING",
              F.lit("present in GL + processor but missing from warehouse")),
        issue(miss_p & ~miss_w, "PROCESSOR_MISSING",
              F.lit("present in GL + warehouse but missing from processor")),
        issue((ng == 1) & (nw == 1) & _amount_differs(ga, wa), "WAREHOUSE_DRIFT", drift_text("WH", wa)),
        issue((ng == 1) & (np_ == 1) & _amount_differs(ga, pa), "PROCESSOR_DRIFT", drift_text("PROC", pa)),
    ))
    return stats.filter((ng == 1) & ((np_ <= 1) | (nw <= 1))) \
        .select(F.col("r_g.raw").alias("txn_id"), F.explode(issues).alias("i")) \
        .select("txn_id", "i.category", "i.evidence", "i.severity")


def three_way_pair_counts(stats: DataFrame) -> DataFrame:
    """only_left / only_right / conflicts for each ordered pair, from the same
    per-key aggregate (no pairwise joins)."""
    def pair(l: str, r: str, name_l: str, name_r: str) -> list[Column]:
        nl, nr = F.col(f"n_{l}"), F.col(f"n_{r}")
        la, ra = F.col(f"r_{l}.amount"), F.col(f"r_{r}.amount")
        return [
            F.struct(F.lit(name_l).alias("left_name"), F.lit(name_r).alias("right_name"),
                     F.count_if((nl == 1) & (nr == 0)).alias("only_left"),
                     F.count_if((nl == 0) & (nr == 1)).alias("only_right"),
                     F.count_if((nl == 1) & (nr == 1) & _amount_differs(la, ra)).alias("conflicts"))]
    row = stats.agg(F.array(*(pair("g", "p", "GL", "PROC") + pair("g", "w", "GL", "WH")
                              + pair("p", "w", "PROC", "WH"))).alias("pairs"))
    return row.select(F.explode("pairs").alias("p")).select("p.*")
