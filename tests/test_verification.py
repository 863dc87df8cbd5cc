"""Hash trees against plain hashing, and files of any size."""

import hashlib

from kinweave import sources


def plain(data: bytes, size: int, fan: int) -> str:
    level = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_trees_of_several_levels(spark, tmp_path):
    sizes = {"one": 1, "edge": 10, "two": 11, "sub/level two": 95, "a % b+c/x": 300, "more": 341}
    for i, (name, n) in enumerate(sizes.items()):
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(bytes((j * 7 + i) % 256 for j in range(n)))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    found = {r.path: (r.byte_size, r.tree_sha256) for r in sources.tree_hashes(spark, str(tmp_path / "in"), size=10, fan=3).collect()}
    assert found == {name: (n, plain((tmp_path / "in" / name).read_bytes(), 10, 3)) for name, n in sizes.items()}
    whole = {r.path: r.tree_sha256 for r in sources.tree_hashes(spark, str(tmp_path / "in")).collect()}
    assert whole == {name: hashlib.sha256((tmp_path / "in" / name).read_bytes()).hexdigest() for name in sizes}


def test_a_file_of_three_gib_is_verified_in_several_tasks(spark, tmp_path):
    file = tmp_path / "in" / "big.bin"
    file.parent.mkdir()
    with file.open("wb") as f:
        f.truncate(3 << 30)
    trees = sources.tree_hashes(spark, str(tmp_path / "in"))
    told = spark.createDataFrame(trees.collect(), trees.schema)
    assert sources.verified(spark, str(tmp_path / "in"), told).first().status == "ok"
    with file.open("r+b") as f:  # one byte, beyond 2 GiB
        f.seek((5 << 29) + 3)
        f.write(b"x")
    assert sources.verified(spark, str(tmp_path / "in"), told).first().status == "changed"
    plainly = told.withColumnRenamed("tree_sha256", "sha256")
    assert sources.verified(spark, str(tmp_path / "in"), plainly).first().status == "unchecked"


def test_missing_and_unhashed_entries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "empty").write_bytes(b"")
    told = spark.createDataFrame([("a", 3, None), ("b", 3, "x"), ("empty", 0, "x")], "path string, byte_size long, tree_sha256 string")
    assert {r.path: r.status for r in sources.verified(spark, str(tmp_path / "in"), told).collect()} == {"a": "unchecked", "b": "missing", "empty": "unchecked"}
