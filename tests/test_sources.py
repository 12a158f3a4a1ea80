"""COPY text, JSON lines, seed rows and snapshots."""

import json
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from depotflow.operators.changes import DELETE, FLAG, INSERT, UPDATE
from depotflow.schemas import MODEL
from depotflow.sources.copysource import blocks, read_copy_block, registered
from depotflow.sources.copytext import read_copy_text, write_copy_text
from depotflow.sources.jsonrows import json_rows, write_json
from depotflow.sources.seeds import SEED_ROWS, seed_rows
from depotflow.sources.snapshots import CommitRefused, SnapshotStore, scan_table
from tests.small import table

STAMP = "2026-01-01 10:20:30.123456"


def test_copy_text_escapes_and_nulls(spark, tmp_path):
    (tmp_path / "c.txt").write_text(
        f"1\ta\\tb\\nc\t\\N\t\t{STAMP}\n"       # escapes; NULL and the empty string apart
        f"2\t\\\\N\\\\t\\q\t\\\\\\t\t \t{STAMP}\n"  # escaped backslashes; an unknown escape
        "\\.\n")
    got = read_copy_text(spark, str(tmp_path), "customers").orderBy("customer_id").collect()
    assert [(r.customer_name, r.phone, r.address) for r in got] == [
        ("a\tb\nc", None, ""), ("\\N\\tq", "\\\t", " ")]
    assert got[0].created_at.microsecond == 123456


def test_copy_text_booleans_decimals_and_generated_columns(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1").write_text(f"1\tx\t\\N\t\\N\t\\N\tf\t{STAMP}\n2\ty\t\\N\t\\N\t\\N\tt\t{STAMP}\n")
    assert {r.supplier_id: r.is_active for r in
            read_copy_text(spark, str(tmp_path / "s"), "suppliers").collect()} == {1: False, 2: True}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1").write_text("1\t2\t3\t10.50\t4.25\t2.00\n")
    row = read_copy_text(spark, str(tmp_path / "l"), "sales_order_lines").head()
    assert (row.pending_quantity, row.line_total) == (D("6.25"), D("21.00"))


def test_copy_text_round_trip(spark, tmp_path):
    text = "tab\t line\n return\r back\\slash \\N \\t \x08\x0b\x0c é"
    rows = table(spark, "customers", [
        {"customer_name": text, "phone": "", "address": None}, {"customer_name": "\\N", "phone": "\\"}])
    write_copy_text(rows, str(tmp_path / "out"), "customers")
    assert sorted(read_copy_text(spark, str(tmp_path / "out"), "customers").collect()) == sorted(
        rows.collect())


def test_copy_source_equals_the_expressions(spark, tmp_path):
    """The same rows in ranges of a few bytes and in one, with columns chosen and filters passed on."""
    rows = table(spark, "customers", [
        {"customer_name": f"né {i}\t\\x" * (i % 5), "phone": None if i % 3 else "\\N", "address": "a\nb"}
        for i in range(40)]).repartition(3)
    write_copy_text(rows, str(tmp_path / "out"), "customers")
    want = sorted(read_copy_text(spark, str(tmp_path / "out"), "customers").collect())
    source = registered(spark).read.format("copytext").options(path=f"file://{tmp_path}/out", table="customers")
    for size in (7, 100, 1 << 20):
        assert sorted(source.option("rangebytes", size).load().collect()) == want
    few = source.schema("customer_id bigint, address string").option(
        "columns", "customer_id,customer_name,phone,address,created_at").load()
    got = few.filter("customer_id > 5 AND customer_id IN (4, 6, 30) AND address IS NOT NULL AND length(address) = 3")
    assert sorted(map(tuple, got.collect())) == [(6, "a\nb"), (30, "a\nb")]
    assert "length" in got._jdf.queryExecution().executedPlan().toString()  # what the source does not test stays with Spark


def test_copy_source_decodes_octal_and_hex_escapes(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1").write_text(
        f"1\t\\101\\x42\\303\\251\\tend\\q\t\\N\t\t{STAMP}\n2\t\\\\101\t\\x4g\té\\xc3\\xa9\t{STAMP}")
    got = registered(spark).read.format("copytext").options(path=str(tmp_path / "c"), table="customers").load()
    assert sorted((r.customer_id, r.customer_name, r.phone, r.address) for r in got.collect()) == [
        (1, "ABé\tendq", None, ""), (2, "\\101", "\x04g", "éé")]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_blocks_of_a_dump_are_read_by_name(spark, tmp_path, size):
    dump, want = ["--\n-- a dump; COPY of nothing\n--\nSET x = 1;\n"], {}
    for name, model in MODEL.items():
        rows = table(spark, name, [{}, {}]).coalesce(1)
        if name == "roles":
            rows = table(spark, name, [{"role_name": "COPY roles (a) FROM stdin;"}, {}]).coalesce(1)
        write_copy_text(rows, str(tmp_path / name), name)
        text = "".join(sorted(p.read_text() for p in (tmp_path / name).glob("part-*")))
        fields = [c.name for c in model.stored]
        if name == "users":  # a field that the model does not have
            fields.insert(2, "password_hash")
            text = "".join("\t".join([*line.split("\t")[:2], "secret", *line.split("\t")[2:]]) + "\n"
                           for line in text.splitlines())
        if name == "roles":
            fields, text = ["role_name", "role_id"], "".join(
                "\t".join(reversed(line.split("\t"))) + "\n" for line in text.splitlines())
        dump.append(f"\nCOPY public.{name} ({', '.join(fields)}) FROM stdin;\n{text}\\.\n\n")
        want[name] = sorted(map(str, rows.collect()))
    (tmp_path / "all.sql").write_text("".join(dump) + "SELECT 1;\n")
    path = str(tmp_path / "all.sql")
    assert [b.table for b in blocks(spark, path, rangebytes=size)] == list(MODEL)
    for name in MODEL if size > 50 else ("roles", "users", "sales_order_lines", "delivery_challans"):
        assert sorted(map(str, read_copy_block(spark, path, name, rangebytes=size).collect())) == want[name], name
    with pytest.raises(KeyError):
        read_copy_block(spark, path, "nothing")


def test_json_keeps_nulls(spark, tmp_path):
    rows = table(spark, "suppliers", [{"email": None, "phone": "1"}])
    write_json(rows, str(tmp_path / "json"))
    line = spark.read.text(str(tmp_path / "json")).head()[0]
    assert json.loads(line)["email"] is None
    assert list(json.loads(line)) == MODEL["suppliers"].names
    assert json_rows(rows).head()[0] == line


def test_seed_rows(spark):
    for name, rows in SEED_ROWS.items():
        df = seed_rows(spark, name)
        assert df.columns == MODEL[name].names
        assert df.schema == MODEL[name].schema or [f.dataType for f in df.schema] == [
            f.dataType for f in MODEL[name].schema]
        assert sorted(map(tuple, df.collect())) == rows


def test_snapshots_switch_together_and_keep_what_is_read(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "w"))
    assert store.last_batch("a") == -1 and len(store.tables()) == 0
    store.commit({"users": table(spark, "users", [{}]), "roles": table(spark, "roles", [{}])})
    before = store.tables()
    more = before["users"].unionByName(table(spark, "users", [{"user_id": 2}]))
    assert store.commit({"users": more}, stream="a", batch_id=4) == 2
    assert before["users"].count() == 1  # an open reader keeps its version
    now = store.tables()
    assert (now["users"].count(), now["roles"].count()) == (2, 1)
    store.commit(stream="b", batch_id=1)  # streams count their batches apart
    assert (store.last_batch("a"), store.last_batch("b"), store.last_batch("c")) == (4, 1, -1)
    for half in ({"batch_id": 5}, {"stream": "a"}):
        with pytest.raises(ValueError, match="with its stream"):
            store.commit(**half)
    assert store.last_batch("a") == 4


def flagged(rows, flag):
    return rows.withColumn(FLAG, F.lit(flag))


def names(store):
    return {r.role_id: r.role_name for r in store.tables()["roles"].collect()}


def test_a_commit_writes_the_rows_that_change(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "w"))
    store.commit({"roles": table(spark, "roles", [{} for _ in range(50)])})
    renamed = flagged(table(spark, "roles", [{"role_id": 3, "role_name": "new"}]), UPDATE)
    added = flagged(table(spark, "roles", [{"role_id": 90}]), INSERT)
    gone = flagged(table(spark, "roles", [{"role_id": 4}]), DELETE)
    store.commit(changes={"roles": renamed.unionByName(added).unionByName(gone)})
    again = flagged(table(spark, "roles", [{"role_id": 3, "role_name": "newer"}]), UPDATE)
    back = flagged(table(spark, "roles", [{"role_id": 4, "role_name": "back"}]), INSERT)
    store.commit(changes={"roles": again.unionByName(back)})
    want = {i: f"role {i}" for i in range(1, 51)} | {3: "newer", 4: "back", 90: "role 1"}
    assert names(store) == want
    written = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "w" / "roles").iterdir())]
    assert sorted(written) == [2, 3, 50]
    before = store.tables()
    store.compact("roles")
    assert names(store) == want and store.tables()._changes["roles"] == []
    assert before["roles"].count() == 51  # a reader of the log goes on


def test_a_log_is_compacted_after_some_commits(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "w"), compact_after=2)
    for i in range(1, 6):
        store.commit(changes={"roles": flagged(table(spark, "roles", [{"role_id": i}]), INSERT)})
        assert len(store.tables()._changes["roles"]) <= 2
    assert set(names(store)) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("links", [True, False])
def test_of_two_writers_one_is_refused(spark, tmp_path, links):
    root = str(tmp_path / "w")
    one, other = SnapshotStore(spark, root), SnapshotStore(spark, root)
    one._manifests.links = other._manifests.links = links
    one.commit({"roles": table(spark, "roles", [{}])})
    seen = other.tables()
    one.commit(changes={"roles": flagged(table(spark, "roles", [{"role_id": 2}]), INSERT)})
    with pytest.raises(CommitRefused, match="was committed after"):  # made from tables that are out of date
        other.commit(changes={"roles": flagged(seen["roles"], UPDATE)}, since=seen)
    # both read the same version before either commits
    now = other._current()
    one.commit(changes={"roles": flagged(table(spark, "roles", [{"role_id": 3}]), INSERT)})
    other._current = lambda: now
    with pytest.raises(CommitRefused, match="another writer"):
        other.commit(changes={"roles": flagged(table(spark, "roles", [{"role_id": 4}]), INSERT)})
    assert set(names(one)) == {1, 2, 3}


def test_many_writers_at_once_take_one_version_each(spark, tmp_path):
    root = str(tmp_path / "w")
    SnapshotStore(spark, root).commit({"roles": table(spark, "roles", [{}])})

    def write(i):
        store = SnapshotStore(spark, root)
        rows = flagged(table(spark, "roles", [{"role_id": 10 + i}]), INSERT)
        for tries in range(50):
            try:
                return store.commit(changes={"roles": rows})
            except CommitRefused:
                continue

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(4)))
    assert sorted(versions) == [2, 3, 4, 5]
    assert set(names(SnapshotStore(spark, root))) == {1, 10, 11, 12, 13}


def test_a_commit_without_manifest_is_not_seen(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "w"))
    store.commit({"roles": table(spark, "roles", [{}])})
    table(spark, "roles", [{}, {}]).write.parquet(str(tmp_path / "w" / "roles" / "v2-lost"))
    assert store.tables()["roles"].count() == 1


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "lines")
    table(spark, "sales_order_lines", [{"so_id": 1, "item_id": 1, "ordered_quantity": 2}]).write.parquet(path)
    df = scan_table(spark, path, "sales_order_lines").filter(F.col("so_id") == 1).select("item_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(so_id), EqualTo(so_id,1)]" in plan
    assert "ReadSchema: struct<so_id:bigint,item_id:bigint>" in plan
