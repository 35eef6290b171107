import gzip
import io
import random

import pytest

from mendseq.sources import gzip_members
from mendseq.sources.fastx import read_fastx
from tests.test_sources import expected, fastq, rows, text_of


def packed(text, cuts):
    """Members cut anywhere, also within a line; some hold nothing."""
    places = [0, *sorted(cuts), len(text)]
    return b"".join(gzip.compress(text[a:b], 1) for a, b in zip(places, places[1:]))


def in_ranges(data, step):
    out = []
    for start in range(0, len(data), step):
        pieces = gzip_members.range_text(io.BytesIO(data), start, min(start + step, len(data)), len(data))
        out += [line for lines in gzip_members.lines_of(pieces) for line in lines]
    return out


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("step", [1, 7, 64, 300, 5000, 10**9])
def test_ranges_hold_each_line_once(step, last):
    rng = random.Random(step)
    for n in (1, 2, 40):
        text = text_of(fastq(n, step), last=last).encode()
        data = packed(text, [rng.randrange(len(text) + 1) for _ in range(rng.choice([0, 3, 30]))])
        assert in_ranges(data, step) == text.decode().removesuffix("\n").split("\n")


def test_long_lines_cross_many_ranges():
    text = b"a" * 3000 + b"\n\n" + b"b" * 2000 + b"\nc"
    data = packed(text, range(0, len(text), 97))
    for step in (10, 50, 1000):
        assert in_ranges(data, step) == text.decode().split("\n")


def test_what_only_looks_like_a_member():
    inner = gzip.compress(b"@not\nread\n")[:-1] + b"x"
    noise = random.Random(1).randbytes(200)
    text = noise.hex().encode() + b"\n"
    # A stored block shows the bytes of its text as they are.
    stored = gzip.compress(b"k" + gzip_members.MAGIC + b"\0" + inner.replace(b"\n", b"-") + b"\n", 0)
    data = stored + gzip.compress(text) + b"\0" * 40
    whole = gzip.decompress(data).decode(errors="replace").removesuffix("\n").split("\n")
    for step in (5, 16, 100):
        assert in_ranges(data, step) == whole


def test_members_broken_off(spark):
    data = packed(b"x\n" * 500, [300])[:-9]
    with pytest.raises(EOFError):
        in_ranges(data, 10**6)


def test_one_file_in_many_tasks(spark, tmp_path):
    first, second = fastq(640, 4), fastq(50, 5)
    lines = text_of(first).encode()
    data = packed(lines, range(0, len(lines), len(lines) // 64))
    (tmp_path / "x.fq.gz").write_bytes(data)
    (tmp_path / "y.fq").write_text(text_of(second))
    paths = [str(tmp_path / n) for n in ("x.fq.gz", "y.fq", "x.fq.gz")]
    step = len(data) // 64
    assert rows(read_fastx(spark, paths, step)) == expected(first, second, first)
    from mendseq.sources.fastx import _lines
    tasks = _lines(spark, paths[:1], step).selectExpr("spark_partition_id() as task").distinct().count()
    assert tasks >= 50
