import itertools
import json
import random

from quern.operators import drift as D
from quern.plans.runtime import materialize

SCHEMA = "event_id bigint, subject string, file_no int, payload string, extra string"


def events(spark, files, subject="s"):
    out, n = [], 0
    for no, recs in files.items():
        for r in recs:
            n += 1
            out.append((n, subject, no, r if isinstance(r, str) or r is None else json.dumps(r), "x"))
    return spark.createDataFrame(out, SCHEMA)


def kinds(df):
    return sorted((r["file_no"], r["change_kind"], r["old_field"], r["new_field"]) for r in df.collect())


def test_every_kind_of_change(spark):
    f1 = [{"id": i, "name": f"n{i}", "n": i, "ok": i % 2 == 0, "tags": [i], "gone": None, "x": 1} for i in range(20)]
    f2 = [{"id": i, "full": {"name": f"n{i}" if i % 5 else "new"}, "n": i + 0.5, "ok": i % 2 == 0, "tags": [i], "came": i, "x": None} for i in range(3, 24)]
    d = D.flattened(events(spark, {1: [*f1, "{broken", None, "", "[1]"], 2: f2, 4: [{"id": 1, "z": 1}]}))
    got = kinds(D.changes(d))
    assert got == [(2, "added", "", "came"), (2, "removed", "gone", ""), (2, "renamed", "name", "full.name"), (2, "retyped", "n", "n")]
    u = D.unified(d, D.changes(d)).where("file_no = 2 and path is null" if False else "file_no = 2")
    assert {r["column_name"] for r in u.collect()} == {"id", "name", "n", "ok", "tags", "came", "x"}


def test_swapped_candidates_are_assigned_by_value(spark):
    a = [{"id": i, "p": i * 7, "q": i * 11} for i in range(30)]
    b = [{"id": i, "q2": i * 7, "p2": i * 11} for i in range(30)]
    assert kinds(D.changes(D.flattened(events(spark, {1: a, 2: b})))) == [(2, "renamed", "p", "q2"), (2, "renamed", "q", "p2")]


def test_repeated_ids_missing_ids_and_empty(spark):
    a = [{"id": 1, "v": 5}, {"id": 1, "v": 6}, {"v": 7}]
    b = [{"id": 1, "w": 6}]
    assert kinds(D.changes(D.flattened(events(spark, {1: a, 2: b})))) == [(2, "renamed", "v", "w")]
    assert D.changes(D.flattened(events(spark, {}))).count() == 0
    deep = {"id": 1}
    for _ in range(300):
        deep = {"id": 1, "d": deep}
    assert D.flattened(events(spark, {1: [deep]})).count() == 301


def test_value_map(spark):
    d = spark.createDataFrame([(1, 1, 2, "pro"), (1, 2, 3, "2"), (2, 1, 2, "pro"), (2, 5, 3, "2"), (3, 1, 2, "pro"), (3, 2, 3, "3"), (4, 1, 2, None)], "id int, pos int, ver int, tier string")
    assert [tuple(r) for r in D.value_map(d, "id", "pos", "ver", "tier", 2, 3).collect()] == [("pro", "2", 2)]


def test_changes_of_a_table_of_versions(spark, tmp_path):
    from quern.queries.data_problems import p5_users, p5_users_changes

    rows = []
    for v in (1, 2, 3, 4):
        for i in range(40):
            name, state, tier = f"n{i}", ("active", "closed", "open")[i % 3], i % 4
            phone = f"+84 {i:03} 77" if v == 2 else f"84{i:03}77"
            rows.append((i, name if v < 4 else None, name if v == 4 else None, state if v == 1 else None, state if v > 1 else None, None if v == 1 else "abcd"[tier] if v == 2 else str(tier), None if v == 1 else phone, f"t{v}-{i}", "u", v * 100 + i, v, "x"))
    d = spark.createDataFrame(rows, "id bigint, username string, login string, status string, account_status string, tier string, phone string, updated_at string, _cdc_op string, _cdc_lsn bigint, _schema_version int, _dw_loaded_at string")
    d.write.parquet(str(tmp_path / "dim_users.parquet"))
    want = [(2, "added", "", "phone"), (2, "added", "", "tier"), (2, "renamed", "status", "account_status"), (3, "recoded", "tier", "tier"), (3, "reformatted", "phone", "phone"), (4, "renamed", "username", "login")]
    assert kinds(p5_users_changes(spark, str(tmp_path))) == want
    u = p5_users(spark, str(tmp_path)).collect()
    assert len(u) == 160 and all(r["username"] == f"n{r['id']}" and r["status"] == ("active", "closed", "open")[r["id"] % 3] for r in u)
    assert all(r["tier"] == str(r["id"] % 4) and r["phone"] == f"84{r['id']:03}77" for r in u if r["_cdc_lsn"] >= 200)


def test_rename_between_files_without_common_ids(spark):
    """By values, type and name; a field that only looks alike in name or only in values isn't one."""
    rows = []
    for i in range(40):
        rows.append(("s", 1, i, json.dumps({"id": i, "status": ["new", "paid", "sent"][i % 3], "amount": i, "flag": i % 2 == 0})))
        rows.append(("s", 2, 100 + i, json.dumps({"id": 1000 + i, "account_status": ["new", "paid", "sent"][i % 3], "amount_note": f"n{i}", "open": i % 2 == 0})))
    df = spark.createDataFrame(rows, "subject string, file_no int, event_id bigint, payload string")
    got = {tuple(r)[2:] for r in D.changes(materialize(D.flattened(df))).collect()}
    assert got == {("renamed", "status", "account_status"), ("removed", "amount", ""), ("removed", "flag", ""), ("added", "", "amount_note"), ("added", "", "open")}


def test_best_pairs_against_all_assignments():
    rnd = random.Random(4)
    for _ in range(30):
        o, c = [f"o{k}" for k in range(rnd.randint(1, 4))], [f"c{k}" for k in range(rnd.randint(1, 4))]
        s = {(x, y): rnd.random() for x in o for y in c if rnd.random() < 0.8}
        total = sum(s[p] for p in D.best_pairs(s))
        cs = [*c, *[None] * len(o)]
        assert abs(total - max(sum(s.get((x, y), 0) for x, y in zip(o, p)) for p in itertools.permutations(cs, len(o)))) < 1e-9
