"""Records of several lines travel together."""

import pyarrow as pa

from lodestone.sources import quoted


def test_records_of_several_lines_share_batches():
    """One batch of lines gives two batches of records at most, not one for each record; crossing ones can be asked for alone."""
    lines = [x for i in range(300) for x in (f'{i},"a'.encode(), b'b"', b"1,c")] + [b'9,"open']
    n = len(lines)
    given = pa.RecordBatch.from_arrays([pa.array(["p"] * n), pa.array([0] * n, pa.int64()), pa.array(lines, pa.binary()), pa.array([False] * n)], names=["_path", "_start", "value", "inside"])
    made = list(quoted._assemble(",")([given]))
    rows = sorted((r["place"], r["kind"], r["record"]) for b in made for r in b.to_pylist())
    assert rows == sorted([*((2 * i, quoted.WHOLE, f'{i},"a\nb"'.encode()) for i in range(300)), *((2 * i + 1, quoted.WHOLE, b"1,c") for i in range(300)), (600, quoted.TAIL, b'9,"open')])
    assert len(made) <= 3
    alone = [r for b in quoted._assemble(",", True)([given]) for r in b.to_pylist()]
    assert [(r["place"], r["kind"], r["record"]) for r in alone] == [(600, quoted.TAIL, b'9,"open')]
