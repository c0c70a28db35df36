"""Fill-in-middle training texts: each text is cut in three and the middle moves to the end, by SQL inside each Arrow batch.

Every batch (in slices of bounded text) is registered with an in-process DuckDB, one statement cuts it, and Arrow goes back.
There is no shuffle, and a row's result depends on its key and text alone, so a task may run again anywhere.

Defined cases: a null text is empty and stays plain, as does one that contains a marker; a null key draws as the empty
string; repeated rows give equal rows; an empty table gives no rows; columns other than key and text are left out, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text registered at once: a code point is a list element of some 50 bytes while it is cut. One longer text goes alone.
SLICE_BYTES = 1 << 20
#: Per cent of texts that are cut, and of those that start with the suffix.
CUT, SUFFIX_FIRST = 90, 20
MARKERS = ("<P>", "<S>", "<M>")


def statement(cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, seed: str = "1") -> str:
    """SQL over ``batch(key, text)``: form, sizes, output, and the text rebuilt from output and form alone.

    A text without markers holds none across a seam either, as no marker begins inside another; so in the
    output each stands once, and splitting there gives the pieces back.
    """
    p, s, m = (x.replace("'", "''") for x in markers)
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT"
    after = lambda x, k: f"split_part({x}, '{k}', 2)"
    before = lambda x, k: f"split_part({x}, '{k}', 1)"
    return f"""
    WITH t AS (SELECT key, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(key::VARCHAR, '')) AS h FROM batch),
    d AS (SELECT key, text, length(text) AS n, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM t),
    f AS (SELECT key, text, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
      CASE WHEN n = 0 OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {cut} THEN 'plain'
           WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d),
    u AS (SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).') END AS units FROM f),
    c AS (SELECT key, text, n, form, a, b, array_to_string(list_slice(units, 1, a), '') AS prefix,
      array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM u),
    o AS (SELECT key, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM c),
    r AS (SELECT *, CASE form WHEN 'plain' THEN output
      WHEN 'psm' THEN {before(after("output", p), s)} || {after("output", m)} || {before(after("output", s), m)}
      ELSE {before(after("output", p), m)} || {after("output", m)} || {before(after("output", s), p)} END AS restored FROM o)
    """


TEXTS = "key, n, form, prefix_chars, middle_chars, output, restored"
DIGESTS = "key, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256"


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.Table]:
    """The rows of a batch, in runs of at most ``size`` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(lengths):
        if k > at and held + n > size:
            yield pa.Table.from_batches([batch.slice(at, k - at)])
            at, held = k, 0
        held += n
    if at < len(lengths):
        yield pa.Table.from_batches([batch.slice(at)])


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", *, digests: bool = False, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, seed: str = "1") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, restored): one row a row of ``docs``; with ``digests``, SHA-256 of the last two.

    Lengths are in code points. ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    sql = statement(cut, suffix_first, markers, seed) + f"SELECT {DIGESTS if digests else TEXTS} FROM r"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    last = "output_sha256 string, restored_sha256 string" if digests else "output string, restored string"
    names = ["key", "n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("output", "restored"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        con.execute("SET preserve_insertion_order = true")
        for batch in batches:
            types = [batch.schema.field("key").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            schema = pa.schema(list(zip(names, types, strict=True)))
            for part in slices(batch, SLICE_BYTES):
                con.register("batch", part)
                got = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from got.cast(schema).to_batches()

    out = rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, {last}")
    return out.withColumnRenamed("key", key)
