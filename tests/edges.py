"""Copies of the test tables without rows, and with rows of nulls, repeats and clashing columns."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASH = ["k", "t", "id", "pos", "line", "isle", "n", "rn", "kind", "level", "base", "h", "area", "slug", "grid", "markdown_"]


def empty_dir(path) -> str:
    for p in glob.glob(f"{DATA}/*.parquet"):
        pq.write_table(pq.read_schema(p).empty_table(), f"{path}/{os.path.basename(p)}")
    return str(path)


def null_dir(path) -> str:
    """Every table with two rows of nulls, its first rows, and these again."""
    for p in glob.glob(f"{DATA}/*.parquet"):
        t = pq.read_table(p)
        nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))
        if os.path.basename(p) in ("mix_target.parquet", "split_limit.parquet", "lang_alias.parquet", "region.parquet", "nation.parquet"):
            out = t
        else:
            head = t.slice(0, 12).cast(nulls.schema)
            out = pa.concat_tables([nulls, head, head])
        for c in CLASH:
            if c not in out.schema.names:
                out = out.append_column(c, pa.array(["x"] * out.num_rows))
        pq.write_table(out, f"{path}/{os.path.basename(p)}")
    return str(path)
