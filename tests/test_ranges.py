"""Hashes of byte ranges and their trees."""

import hashlib
import random

import pytest

from tablewright.plans import manifest


def plain_tree(data, chunk, fan_out):
    level = [hashlib.sha256(data[i:i + chunk]).hexdigest() for i in range(0, len(data), chunk)]
    while True:
        level = [hashlib.sha256("".join(level[i:i + fan_out]).encode()).hexdigest() for i in range(0, len(level), fan_out)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("fan_out", [3, 1024])
def test_trees_against_hashlib(spark, tmp_path, monkeypatch, fan_out):
    monkeypatch.setattr(manifest, "FAN_OUT", fan_out)
    draw = random.Random(1)
    folder = tmp_path / "a folder=ü %20"
    folder.mkdir()
    content = {f"f {n}.bin": draw.randbytes(n) for n in (1, 99, 100, 101, 1000, 2345)}
    for name, data in content.items():
        (folder / name).write_bytes(data)
    got = {r.file: (r.size, r.sha256) for r in manifest.file_hash(spark, str(folder), chunk=100).collect()}
    assert got == {name: (len(d), hashlib.sha256(d).hexdigest() if len(d) <= 100 else plain_tree(d, 100, fan_out))
                   for name, d in content.items()}
    ranges = manifest.range_hashes(spark, str(folder), chunk=100).collect()
    assert {(r.file, r.offset, r.length, r.sha256) for r in ranges} == {
        (name, i, len(d[i:i + 100]), hashlib.sha256(d[i:i + 100]).hexdigest())
        for name, d in content.items() if len(d) > 100 for i in range(0, len(d), 100)}


def test_changes_are_found_in_their_range(spark, tmp_path):
    path = tmp_path / "x.csv"
    lines = [f"{i:09d}" for i in range(5000)]
    path.write_text("\n".join(["number01", *lines]) + "\n")
    manifest.manifest_create(spark, str(path), chunk=1000)
    assert manifest.manifest_verify(spark, str(path)).first()["passed"]
    assert manifest.changed_ranges(spark, str(path)).isEmpty()
    data = bytearray(path.read_bytes())
    data[12_345] = ord("9")
    path.write_bytes(bytes(data) + b"000005000\n")
    row = manifest.manifest_verify(spark, str(path)).first()
    assert not row["passed"] and row["changed"] == 1
    got = {(r.offset, r.length, r.status) for r in manifest.changed_ranges(spark, str(path)).collect()}
    size = len(data)
    tail = size // 1000 * 1000
    assert got == {(12_000, 1000, "changed"), (tail, size + 10 - tail, "changed" if size > tail else "new")}
    path.unlink()
    assert manifest.manifest_verify(spark, str(path)).first()["missing"] == 1
    assert {r.status for r in manifest.changed_ranges(spark, str(path)).collect()} == {"missing"}


def test_joined_hash_is_that_of_one_file(spark, tmp_path):
    draw = random.Random(2)
    parts = {f"part-{i:05d}": draw.randbytes(n) for i, n in enumerate((5, 3_000_000, 0, 77))}
    for name in reversed(parts):
        (tmp_path / name).write_bytes(parts[name])
    whole = b"".join(parts.values())
    assert [tuple(r) for r in manifest.joined_hash(spark, str(tmp_path)).collect()] == [
        (len(whole), hashlib.sha256(whole).hexdigest())]


@pytest.mark.parametrize("n", [0, 3000])
def test_text_of_orders_has_one_hash(spark, tmp_path, n):
    """One hash of all lines, as the SQL has it, whatever the number of parts; keys and values may be null."""
    import duckdb
    from tablewright.registry import load_all
    draw = random.Random(3)
    rows = [(i * 7 % 40_009, draw.choice(["1-URGENT", "5-LOW", None])) for i in range(n)] + [(None, "2-HIGH")] * (n > 0)
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderpriority string").repartition(7).write.parquet(str(tmp_path / "orders.parquet"))
    queries, oracles = load_all()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in queries["file_hash_text"](spark, str(tmp_path)).collect()]
    assert len(got) == 1 and got == db.execute(oracles["file_hash_text"]).fetchall()
