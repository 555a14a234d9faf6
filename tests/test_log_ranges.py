"""Log files cut anywhere give the entries of the whole file."""

import random

import pytest

from millrace.sources import logs


def whole(text):
    """(line number, text) of each entry, by one loop over the lines of a file."""
    import re

    out, lines = [], re.split("\r\n|[\n\r\u0085  ]", text)
    if lines and lines[-1] == "" and text[-1:] in ("\n", "\r"):
        lines.pop()
    for i, line in enumerate(lines, 1):
        if re.match(logs.OPENS, line):
            out.append([i, line])
        elif out:
            out[-1][1] += "\n" + line
    return [tuple(x) for x in out]


def sample(seed):
    rng = random.Random(seed)
    lines = ["before", ""] if seed % 2 else []
    for i in range(25):
        lines.append(f"2026-05-19 13:42:{i:02d},362 (AL) [94] INFO  a.B Go - entry {i} é世")
        lines += ["", "  tail " * rng.randint(0, 9), "2026-05-19 is no header"][: rng.choice([0, 0, 1, 3])]
        if i % 20 == 7:
            lines += [f"long {k}" for k in range(20)]
    if seed == 2:
        lines.append("odd separators\u0085here")
    return (rng.choice(["\n", "\r\n"])).join(lines) + ("\n" if seed % 3 == 0 else "")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    for k in range(4):
        (d / f"{k}.log").write_bytes(sample(k).encode())
    (d / "empty.log").write_bytes(b"")
    (d / "none.log").write_bytes(b"no header\nat all\n")
    return d


@pytest.mark.parametrize("size", [97, 134217728])
def test_files_cut_anywhere(spark, folder, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = logs.read_log_entries(spark, str(folder)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_file = {}
    for r in sorted(got, key=lambda r: r.line_number):
        by_file.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.line_number, r.raw))
    assert by_file == {f"{k}.log": whole(sample(k)) for k in range(4)}


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"")
    assert logs.read_log_entries(spark, str(tmp_path)).count() == 0


def test_lines_move_once(spark, folder):
    """Windows and groups inside a range share one shuffle by range: none is by entry, and none gathers a file's lines."""
    got = logs.read_log_entries(spark, str(folder))
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert all(", k#" not in x for x in moved) and sum("part#" in x for x in moved) >= 2
