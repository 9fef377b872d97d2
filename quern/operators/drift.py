"""Schemas that drift between files: every change is reported, every file read into one table.

Payloads are flattened to (field, JSON type, value) per record. Each column of a file gets
a profile: its types, its name, and a sketch of its values: the values of a fixed sample
of record ids that is drawn by hash, so that two files sample the same ids. Fields that
go in a file and fields that come are two sides of a bipartite graph, weighted by how far
their sketches agree on common ids, then by type and name; the best assignment gives the
candidates for renames, and an exact comparison over all common ids decides. Where two files have no id in
common, sketches of the values themselves are compared, with types and names. Fields
of a subject that are linked by renames are one column of the unified table.

Defined cases: payloads that are no JSON objects are unreadable and skipped; a file
without readable payloads has no fields; the last of repeated ids in a file (by event
id) counts for renames, while types and fields count from all rows; numbers are integers
if written without fraction; a field with several types has the most frequent, a tie goes
to the first by name; null subjects or file numbers are skipped; empty input gives no changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..plans.runtime import materialize

#: Ids sampled for a column's sketch, per file: one for each hash bucket.
SKETCH_IDS = 1024
#: Least part of the common ids that must hold the same value for a rename.
SAME_VALUES = 0.5
#: Files without a common id: distinct values in a field's sketch, and least likeness of the names (1 less edits by length).
SKETCH_VALUES = 256
NAME_LIKENESS = 0.3

_FIELD_SCHEMA = "subject string, file_no int, event_id long, id string, path string, jtype string, value string"


def _leaves(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Fields of an object, nested ones as a.b; without recursion, so depth has no limit."""
    stack = [(prefix, o)]
    while stack:
        p, d = stack.pop()
        for k, v in d.items():
            if isinstance(v, dict) and v:
                stack.append((f"{p}{k}.", v))
            else:
                yield p + str(k), v


_JTYPES = {bool: "boolean", int: "integer", float: "fraction", str: "string", list: "array", dict: "object"}


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("subject", pa.string()), ("file_no", pa.int32()), ("event_id", pa.int64()), ("id", pa.string()), ("path", pa.string()), ("jtype", pa.string()), ("value", pa.string())])
    write, read = json.JSONEncoder(sort_keys=True).encode, json.JSONDecoder().decode
    for b in batches:
        at, ids, paths, kinds, values = [], [], [], [], []
        for i, text in enumerate(b.column("payload").to_pylist()):
            if text is None:
                continue
            try:
                o = read(text)
            except (ValueError, RecursionError):
                continue
            if not isinstance(o, dict):
                continue
            key, before = write(o.get("id")), len(paths)
            for p, v in _leaves(o):
                paths.append(p.encode("utf-8", "backslashreplace").decode())  # half a surrogate pair is no text
                kinds.append("null" if v is None else _JTYPES[type(v)])
                values.append(None if v is None else write(v))
            n = len(paths) - before
            at += [i] * n
            ids += [key] * n
        rows = b.select(["subject", "file_no", "event_id"]).take(pa.array(at, "int64"))
        yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(rows.columns, schema)), pa.array(ids, "string"), pa.array(paths, "string"), pa.array(kinds, "string"), pa.array(values, "string")], schema=schema)


def flattened(events: DataFrame) -> DataFrame:
    """A row per record and field: subject, file_no, event_id, id, path, jtype, value (as JSON)."""
    src = events.where("subject is not null and file_no is not null").select("subject", F.col("file_no").cast("int").alias("file_no"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(-1)).alias("event_id"), "payload")
    return src.mapInArrow(_flatten, _FIELD_SCHEMA)


def profiles(fields: DataFrame) -> DataFrame:
    """Per column of a file: jtype (most frequent non-null type), n_rows, n_null."""
    by_type = fields.groupBy("subject", "file_no", "path", "jtype").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col("jtype") != "null", F.struct(F.col("n"), F.col("jtype")))
    return by_type.groupBy("subject", "file_no", "path").agg(F.max_by("jtype", F.when(F.col("jtype") != "null", F.struct("n", -F.ascii("jtype")))).alias("jtype"), F.sum("n").alias("n_rows"), F.sum(F.when(F.col("jtype") == "null", F.col("n")).otherwise(0)).alias("n_null"), F.count(real).alias("_k")).withColumn("jtype", F.when(F.col("_k") > 0, F.col("jtype"))).drop("_k")


def file_steps(prof: DataFrame) -> DataFrame:
    """Columns of each file beside those of the file before: subject, file_no, path, side, types.

    ``side`` is gone, come or both; only files whose predecessor is there take part.
    """
    files = prof.select("subject", "file_no").distinct()
    paired = files.join(files.select("subject", (F.col("file_no") + 1).alias("file_no")), ["subject", "file_no"], "left_semi")
    now = prof.select("subject", "file_no", "path", F.col("jtype").alias("new_type"), F.lit(True).alias("_n"))
    old = prof.select("subject", (F.col("file_no") + 1).alias("file_no"), "path", F.col("jtype").alias("old_type"), F.lit(True).alias("_o"))
    j = now.join(old, ["subject", "file_no", "path"], "full_outer").join(paired, ["subject", "file_no"], "left_semi")
    side = F.when(F.col("_n").isNull(), "gone").when(F.col("_o").isNull(), "come").otherwise("both")
    return j.select("subject", "file_no", "path", side.alias("side"), "old_type", "new_type")


def _agreement(gone: DataFrame, come: DataFrame) -> DataFrame:
    """For each gone and come field of a step: common ids and how many of them hold the same value."""
    g = gone.select("subject", "file_no", "id", F.col("path").alias("old_field"), F.col("value").alias("_v"))
    c = come.select("subject", "file_no", "id", F.col("path").alias("new_field"), F.col("value").alias("_w"))
    return g.join(c, ["subject", "file_no", "id"]).groupBy("subject", "file_no", "old_field", "new_field").agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.col("_v") == F.col("_w")).alias("n_same"))


def _leaf(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", ""))


def best_pairs(scores: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Best assignment of gone to come fields of one file step (its size is that of the schema): shortest augmenting paths."""
    rows, cols = sorted({o for o, _ in scores}), sorted({c for _, c in scores})
    n, m = len(rows), max(len(rows), len(cols))
    cost = [[-scores.get((o, c), 0.0) for c in cols] + [0.0] * (m - len(cols)) for o in rows]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0, low, way, used = i, 0, [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0], i0, delta, j1 = True, owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    d = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if d < low[j]:
                        low[j], way[j] = d, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return [(rows[owner[j] - 1], cols[j - 1]) for j in range(1, len(cols) + 1) if owner[j] and cost[owner[j] - 1][j - 1] < 0]


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Assignments of all steps of a partition that is sorted by step; one step's scores are held at a time."""
    now, scores = None, {}
    for b in batches:
        out = []
        for subject, no, o, c, s in zip(b["subject"], b["file_no"], b["old_field"], b["new_field"], b["score"]):
            if (subject, no) != now:
                out += [(*now, x, y) for x, y in best_pairs(scores)] if now else []
                now, scores = (subject, no), {}
            scores[o, c] = float(s)
        yield pd.DataFrame(out, columns=["subject", "file_no", "old_field", "new_field"])
    if now:
        yield pd.DataFrame([(*now, x, y) for x, y in best_pairs(scores)], columns=["subject", "file_no", "old_field", "new_field"])


def _assigned(near: DataFrame, label: str) -> DataFrame:
    # a fixed number of partitions, since small rows would be brought into one task
    n = max(1, int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = near.select("subject", "file_no", "old_field", "new_field", "score").repartition(n, "subject", "file_no").sortWithinPartitions("subject", "file_no")
    return materialize(rows.mapInPandas(_assign, "subject string, file_no int, old_field string, new_field string"), label)


def _name_likeness() -> Column:
    return 1 - F.levenshtein(_leaf("old_field"), _leaf("new_field")) / F.greatest(F.length(_leaf("old_field")), F.length(_leaf("new_field")), F.lit(1))


def _by_distribution(f: DataFrame, kinds: DataFrame) -> DataFrame:
    """Renames in steps whose two files have no id in common: fields of one type with like names and overlapping values.

    A field's values are sketched by those of least hash (``SKETCH_VALUES`` distinct ones); the overlap is the part of the smaller
    sketch, below the lesser of both ends, that the other one has as well.
    """
    step = ["subject", "file_no"]
    both = f.groupBy(*step, "id").agg((F.count_if(F.col("side") == "gone") > 0).alias("g"), (F.count_if(F.col("side") == "come") > 0).alias("c"))
    alone = materialize(both.groupBy(*step).agg(F.max(F.col("g") & F.col("c")).alias("met")).where("not met").select(*step), "steps-apart")
    if alone.isEmpty():
        return f.sparkSession.createDataFrame([], "subject string, file_no int, old_field string, new_field string")
    apart = f.join(alone, step, "left_semi")
    own = apart.groupBy(*step, "side", "path", F.xxhash64("value").alias("h")).agg(F.lit(1).alias("_1"))
    w = Window.partitionBy(*step, "side", "path").orderBy("h")
    sk = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SKETCH_VALUES).groupBy(*step, "side", "path").agg(F.collect_list("h").alias("hs"))  # at most SKETCH_VALUES entries
    g = sk.where("side = 'gone'").select(*step, F.col("path").alias("old_field"), F.col("hs").alias("a"))
    c = sk.where("side = 'come'").select(*step, F.col("path").alias("new_field"), F.col("hs").alias("b"))
    end = F.least(F.array_max("a"), F.array_max("b"))
    a, b = (F.filter(x, lambda h: h <= end) for x in ("a", "b"))
    j = g.join(c, step).withColumn("overlap", F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))
    j = _with_types(j, kinds).where((F.col("t1") == F.col("t2")) & (F.col("overlap") >= SAME_VALUES)).withColumn("_name", _name_likeness()).where(F.col("_name") >= NAME_LIKENESS)
    return _assigned(j.withColumn("score", F.col("overlap") + F.col("_name")), "assigned-apart")


def _with_types(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    return pairs.join(kinds.withColumnsRenamed({"path": "old_field", "t": "t1"}), ["subject", "file_no", "old_field"]).join(kinds.withColumnsRenamed({"path": "new_field", "t": "t2"}), ["subject", "file_no", "new_field"])


def renames(fields: DataFrame, steps: DataFrame, without_ids: bool = True) -> DataFrame:
    """Renamed fields: subject, file_no, old_field, new_field; ``without_ids`` looks at files without a common id as well."""
    newest = Window.partitionBy("subject", "file_no", "id", "path").orderBy(F.col("event_id").desc(), F.col("value").desc())
    # only steps in which fields both go and come can hold a rename
    open_steps = steps.groupBy("subject", "file_no").agg(F.max(F.col("side") == "gone").alias("g"), F.max(F.col("side") == "come").alias("c")).where("g and c").select("subject", "file_no")
    changed = steps.where("side <> 'both'").join(open_steps, ["subject", "file_no"], "left_semi").select("subject", "file_no", "path", "side")
    at = changed.withColumn("_at", F.when(F.col("side") == "gone", F.col("file_no") - 1).otherwise(F.col("file_no")))
    f = fields.where("value is not null").withColumnRenamed("file_no", "_at").join(at, ["subject", "_at", "path"])
    f = f.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("subject", "file_no", "id", "path", "side", "value")
    f = materialize(f, "changed-fields")
    bucket = F.pmod(F.xxhash64("id"), F.lit(SKETCH_IDS))
    least = Window.partitionBy("subject", "file_no", "side", "path", "_b")
    sketch = f.withColumn("_b", bucket).withColumn("_m", F.min(F.xxhash64(F.lit(7), "id")).over(least)).where(F.xxhash64(F.lit(7), "id") == F.col("_m"))
    near = _agreement(sketch.where("side = 'gone'"), sketch.where("side = 'come'"))
    kinds = steps.select("subject", "file_no", "path", F.coalesce("old_type", "new_type").alias("t"))
    near = _with_types(near, kinds)
    score = F.col("n_same") / F.col("n_common") + F.when(F.col("t1") == F.col("t2"), 0.02).otherwise(0.0) + 0.05 * _name_likeness()
    near = near.where("n_same > 0").withColumn("score", score)
    found = _assigned(near, "assigned")
    exact = _agreement(
        f.where("side = 'gone'").join(found.select("subject", "file_no", F.col("old_field").alias("path")), ["subject", "file_no", "path"], "left_semi"),
        f.where("side = 'come'").join(found.select("subject", "file_no", F.col("new_field").alias("path")), ["subject", "file_no", "path"], "left_semi"),
    ).where(F.col("n_same") >= SAME_VALUES * F.col("n_common"))
    same = found.join(exact, ["subject", "file_no", "old_field", "new_field"], "left_semi")
    return same.unionByName(_by_distribution(f, kinds)) if without_ids else same


def changes(fields: DataFrame, without_ids: bool = True) -> DataFrame:
    """All changes between files: subject, file_no, change_kind, old_field, new_field."""
    steps = materialize(file_steps(profiles(fields)), "steps")
    r = materialize(renames(fields, steps, without_ids), "renames")
    gone = steps.where("side = 'gone'").join(r.select("subject", "file_no", F.col("old_field").alias("path")), ["subject", "file_no", "path"], "left_anti")
    come = steps.where("side = 'come'").join(r.select("subject", "file_no", F.col("new_field").alias("path")), ["subject", "file_no", "path"], "left_anti")
    retyped = steps.where("side = 'both' and old_type <> new_type")
    none = F.lit("")

    def row(df: DataFrame, kind: str, old: Column, new: Column) -> DataFrame:
        return df.select("subject", "file_no", F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))

    p = F.col("path")
    return row(r, "renamed", F.col("old_field"), F.col("new_field")).unionByName(row(gone, "removed", p, none)).unionByName(row(come, "added", none, p)).unionByName(row(retyped, "retyped", p, p))


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns of one subject by file, with the name each had first (its size is files times fields)."""
    name: dict[str, str] = {}
    out = []
    for no in sorted(pdf["file_no"].unique()):
        part = pdf[pdf["file_no"] == no]
        now = {}
        for p, old in zip(part["path"], part["old_field"]):
            now[p] = name.get(old, old) if isinstance(old, str) else name.get(p, p)
        name = name | now
        out += [(part["subject"].iloc[0], no, p, c) for p, c in now.items()]
    return pd.DataFrame(out, columns=["subject", "file_no", "path", "column_name"])


def unified(fields: DataFrame, all_changes: DataFrame) -> DataFrame:
    """One consistent table of all files: subject, column_name, file_no, event_id, id, jtype, value."""
    renamed = all_changes.where("change_kind = 'renamed'").select("subject", "file_no", F.col("new_field").alias("path"), "old_field")
    cols = fields.select("subject", "file_no", "path").distinct().join(renamed, ["subject", "file_no", "path"], "left")
    names = cols.groupBy("subject").applyInPandas(_chains, "subject string, file_no int, path string, column_name string")
    return fields.join(names, ["subject", "file_no", "path"]).select("subject", "column_name", "file_no", "event_id", "id", "jtype", "value")


def value_map(rows: DataFrame, key: str, order: str, version: str, column: str, old: int, new: int) -> DataFrame:
    """How the values of a column were recoded between two versions: (old_value, new_value, n).

    Each key's last value under the old version is held against its first under the new one;
    the most frequent partner wins. A row per old value.
    """
    v = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(column).isNotNull())
    a = v.where(F.col(version) == old).groupBy(key).agg(F.max_by(column, order).alias("old_value"))
    b = v.where(F.col(version) == new).groupBy(key).agg(F.min_by(column, order).alias("new_value"))
    n = a.join(b, key).groupBy("old_value", "new_value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("old_value").agg(F.max_by("new_value", F.struct("n", "new_value")).alias("new_value"), F.max("n").alias("n"))


def table_fields(rows: DataFrame, subject: str, version: str, order: str, key: str) -> DataFrame:
    """A table that holds several versions of its own schema as ``flattened`` has events: a row per key and filled column.

    Columns starting with an underscore are bookkeeping. A column that no row of a version fills isn't there in that version.
    """
    cols = [c for c in rows.columns if c != key and not c.startswith("_")]
    kinds = dict(rows.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("path"), F.lit(kinds[c]).alias("jtype"), F.col(c).cast("string").alias("value")) for c in cols])
    r = rows.where(F.col(version).isNotNull() & F.col(key).isNotNull()).select(F.col(version).cast("int").alias("file_no"), F.coalesce(F.col(order).cast("bigint"), F.lit(-1)).alias("event_id"), F.col(key).cast("string").alias("id"), cells.alias("_cells"))
    return r.select(F.lit(subject).alias("subject"), "file_no", "event_id", "id", F.inline("_cells")).where("value is not null")


def recodings(fields: DataFrame, all_changes: DataFrame) -> DataFrame:
    """Columns that stay or are renamed but hold their values otherwise than in the version before, shaped as ``changes``.

    Each key's last value under the old version is held against its first under the new one. Where most keys hold
    another text, the column is ``reformatted`` if most agree in letters and digits, and ``recoded`` if most of the
    new values are new to the column and the most frequent partner of each old value accounts for most keys.
    """
    paths = fields.select("subject", "file_no", "path").distinct()
    renamed = all_changes.where("change_kind = 'renamed'").select("subject", "file_no", F.col("new_field").alias("path"), "old_field")
    steps = paths.join(renamed, ["subject", "file_no", "path"], "left").select("subject", "file_no", F.coalesce("old_field", "path").alias("old_field"), F.col("path").alias("new_field"))
    key = ["subject", "file_no", "path", "id"]
    old = fields.groupBy(*key).agg(F.max_by("value", F.struct("event_id", "value")).alias("v")).select("subject", (F.col("file_no") + 1).alias("file_no"), F.col("path").alias("old_field"), "id", "v")
    new = fields.groupBy(*key).agg(F.min_by("value", F.struct("event_id", "value")).alias("w")).withColumnRenamed("path", "new_field")
    step = ["subject", "file_no", "old_field", "new_field"]
    plain = [F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")) for c in ("v", "w")]
    pairs = new.join(steps, ["subject", "file_no", "new_field"]).join(old, ["subject", "file_no", "old_field", "id"]).groupBy(*step, "v", "w").agg(F.count(F.lit(1)).alias("n"))
    known = fields.select("subject", (F.col("file_no") + 1).alias("file_no"), F.col("path").alias("old_field"), F.col("value").alias("w"), F.lit(True).alias("_known")).distinct()
    pairs = materialize(pairs.join(known, ["subject", "file_no", "old_field", "w"], "left"), "value-pairs")
    by_old = pairs.groupBy(*step, "v").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(F.when(F.col("v") == F.col("w"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(plain[0] == plain[1], F.col("n")).otherwise(0)).alias("alike"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("fresh"))
    t = by_old.groupBy(*step).agg(F.sum("n").alias("n"), F.sum("top").alias("top"), F.sum("same").alias("same"), F.sum("alike").alias("alike"), F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("n_old"))
    most = F.col("n") * SAME_VALUES
    kind = F.when(F.col("alike") >= most, "reformatted").when((F.col("fresh") >= most) & (F.col("top") >= most) & (2 * F.col("n_old") <= F.col("n")), "recoded")
    return t.where(F.col("same") < most).select("subject", "file_no", kind.alias("change_kind"), "old_field", "new_field").where("change_kind is not null")


def table_changes(fields: DataFrame) -> DataFrame:
    """``changes`` and ``recodings`` of a table."""
    c = materialize(changes(fields), "changes")
    return c.unionByName(recodings(fields, c))


def unified_table(rows: DataFrame, found: list[Row], version: str, order: str, key: str) -> DataFrame:
    """The rows in one shape, by the changes found: a renamed column under its first name, recoded values in the latest codes, reformatted ones as letters and digits."""
    first: dict[str, str] = {}
    for r in sorted((r for r in found if r["change_kind"] == "renamed"), key=lambda r: r["file_no"]):
        first[r["new_field"]] = first.get(r["old_field"], r["old_field"])
    for r in sorted((r for r in found if r["change_kind"] in ("recoded", "reformatted")), key=lambda r: r["file_no"]):
        old, new, no = r["old_field"], r["new_field"], r["file_no"]
        if r["change_kind"] == "reformatted":
            rows = rows.withColumns({c: F.regexp_replace(F.col(c).cast("string"), r"[^\p{L}\p{N}]+", "") for c in {old, new}})
            continue
        same = rows.withColumn("_held", F.when(F.col(version) == no, F.col(new)).otherwise(F.col(old)))
        codes = value_map(same, key, order, version, "_held", no - 1, no)
        # rows without a version are of the old one if they hold one of its codes only
        own = codes.join(codes.select(F.col("new_value").alias("old_value")).distinct(), "old_value", "left_semi").select("old_value", F.lit(True).alias("_both"))
        codes = codes.join(own, "old_value", "left").select(F.col("old_value").alias(old), F.col("new_value").alias("_code"), "_both", F.lit(True).alias("_coded"))
        before = F.coalesce(F.col(version) < no, F.col("_coded") & F.col("_both").isNull(), F.lit(False))
        rows = rows.join(codes, old, "left").withColumn(old, F.when(before, F.col("_code")).otherwise(F.col(old))).drop("_code", "_both", "_coded")
    for c in {first[x] for x in first}:
        rows = rows.withColumn(c, F.coalesce(*[x for x in reversed(first) if first[x] == c], c))
    return rows.drop(*first)
