"""Readers for the messy public-data shapes the reference lands (SRC1-SRC12).

Every reader returns a lazy DataFrame parsed by executors.  Only metadata
is looked at on the driver: a header line per distinct file layout, the
schema Spark infers, or a catalog listing.

Preamble CSVs are read as plain lines; each line carries its file path, the
start offset of its split, and ``monotonically_increasing_id``.  Within one
split the ids are consecutive in file order, so ``id - min(id)`` over the
first split of a file is the line number.  The header search therefore
touches only the first split of each file and needs no whole-file rows.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.columns import to_double, try_number
from supplylens.operators.grid import sanitize_names, unique_labels
from supplylens.session import scratch_path

# Words marking metadata lines in statistical CSV preambles,
# the fallback header line, the preamble date format and the missing-value
# token of delimited downloads.
PREAMBLE_SKIP_WORDS = ("Units", "Title", "Description")
PREAMBLE_FALLBACK_LINE = 10
PREAMBLE_DATE_FORMAT = "dd-MMM-yyyy"
MISSING_TOKEN = "."


# --------------------------------------------------------------------------
# SRC1 delimited text
# --------------------------------------------------------------------------


def read_delimited(spark: SparkSession, path: str | Sequence[str],
                   types: Mapping[str, str] | None = None,
                   rename: Mapping[str, str] | None = None, na: str = MISSING_TOKEN,
                   encoding: str = "UTF-8", header: bool = True,
                   dropna: bool | Sequence[str] = True, sep: str = ",") -> DataFrame:
    """Header CSV read as text first, then typed with ``try_cast``.

    ``na`` marks missing values; rows missing any typed column (or the
    listed columns) are dropped.  ``encoding`` accepts ISO-8859-1 for the
    Windows-1252 style files.
    """
    df = (spark.read.option("header", header).option("nullValue", na)
          .option("encoding", encoding).option("sep", sep).option("inferSchema", False)
          .csv(path))
    types = dict(types or {})
    for c, t in types.items():
        txt = F.trim(F.col(c))
        numeric = t.lower() in ("tinyint", "smallint", "int", "integer", "bigint", "long",
                                "float", "double", "real") or t.lower().startswith("decimal")
        df = df.withColumn(c, try_number(txt, t) if numeric else txt.try_cast(t))
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    if dropna:
        cols = list(dropna) if not isinstance(dropna, bool) else \
            [(rename or {}).get(c, c) for c in types]
        if cols:
            df = df.dropna(subset=cols)
    return df


# --------------------------------------------------------------------------
# SRC2 delimited text with a preamble
# --------------------------------------------------------------------------


def _indexed_lines(spark: SparkSession, path) -> DataFrame:
    # a UTF-8 byte-order mark, if any, sits at the start of a file's first line
    return spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"))


def preamble_headers(lines: DataFrame, fallback: int = PREAMBLE_FALLBACK_LINE,
                     skip_words: Sequence[str] = PREAMBLE_SKIP_WORDS) -> DataFrame:
    """Per file: ``(file, block, mid, header_line)``; block and mid place the header.

    The first data line is the first line not naming a skip word, with more
    than three comma fields and a digit in the first four characters; the
    header is the nearest non-empty line above it not starting with ``#``.
    Without either, line ``fallback`` is the header.

    All lines of a file take part, wherever its splits fall: the first data
    line and the header are two partial aggregates in (block, mid) order, and
    the fallback keeps a few lines per task.
    """
    pos = F.struct("block", "mid")
    parts = F.split(F.trim("line"), ",")
    skip = F.lit(False)
    for wd in skip_words:
        skip = skip | F.col("line").contains(wd)
    is_data = ~skip & (F.size(parts) > 3) & F.substring(parts[0], 1, 4).rlike("[0-9]")
    first = (lines.filter(is_data).groupBy(F.col("file").alias("_file"))
             .agg(F.min(pos).alias("_first")))
    above = (lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
             .join(first, F.col("file") == F.col("_file")).filter(pos < F.col("_first")))
    found = above.groupBy("file").agg(F.max(F.struct("block", "mid", "line")).alias("found"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("block", "mid"))
    other = (lines.withColumn("_n", rank).filter(F.col("_n") <= fallback + 1)
             .filter(F.col("_n") == fallback + 1)
             .select(F.col("file").alias("_f"), F.struct("block", "mid", "line").alias("other")))
    head = F.coalesce("found", "other")
    return (found.join(other, F.col("file") == F.col("_f"), "full_outer")
            .select(F.coalesce("file", "_f").alias("file"), head.getField("block").alias("block"),
                    head.getField("mid").alias("mid"), head.getField("line").alias("header_line")))


def read_preamble_csv(spark: SparkSession, path: str | Sequence[str],
                      fallback: int = PREAMBLE_FALLBACK_LINE,
                      date_format: str = PREAMBLE_DATE_FORMAT, numeric: bool = True) -> DataFrame:
    """SRC2: CSV with a metadata preamble; first column becomes ``date``.

    Bad dates are dropped, as are rows with every field empty.  Other
    columns are numbers (NULL where not numeric) unless ``numeric=False``.
    """
    lines = _indexed_lines(spark, path)
    # The per-file header table (one small row per file) is landed once in
    # the shared scratch folder: the listing of names and the body join both
    # read it, so the lines are scanned twice in total, not three times.
    # The body is one scan and one projection, however many layouts there are.
    meta_path = scratch_path(spark, "preamble-meta")
    (preamble_headers(lines, fallback).filter(F.col("header_line").isNotNull())
     .write.mode("overwrite").parquet(meta_path))
    meta = spark.read.parquet(meta_path)
    heads = meta.select(F.col("file").alias("_file"), F.struct("block", "mid").alias("_head"), "header_line")
    body = (lines.join(heads, F.col("file") == F.col("_file"))
            .filter(F.struct("block", "mid") > F.col("_head")))
    names = _header_names(F.col("header_line"), first="date")
    out, columns = _by_header(body.select("line", "header_line"), meta.select("header_line"), names)
    if not columns:
        return spark.createDataFrame([], "date DATE")
    out = out.select(*columns)
    any_value = F.lit(False)
    for c in out.columns:
        any_value = any_value | (F.col(c).isNotNull() & (F.trim(F.col(c)) != ""))
    out = out.filter(any_value)
    typed = [F.try_to_date(F.trim("date"), date_format).alias("date")]
    typed += [(to_double(c) if numeric else F.col(c)).alias(c) for c in out.columns if c != "date"]
    return out.select(*typed).filter(F.col("date").isNotNull())


def _n_fields(line: Column) -> Column:
    """How many delimited fields a line has; commas within quotes don't count."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _header_names(header: Column, first: str | None = None):
    """A function of the widest header's width that gives a header's names: storage-safe and unique (GRD8)."""
    def names(width: int) -> Column:
        found = F.slice(_fields(header, width), 1, _n_fields(header))
        safe = unique_labels(found)
        return unique_labels(F.concat(F.array(F.lit(first)), F.slice(safe, 2, width))) if first else safe
    return names


def _fields(line: Column, width: int) -> Column:
    """The fields of a line by position, quotes taken off; a missing or empty field is NULL."""
    row = F.from_csv(line, ", ".join(f"c{i} STRING" for i in range(width)))
    return F.array(*[row[f"c{i}"] for i in range(width)])


def _by_header(body: DataFrame, headers: DataFrame, names, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Lines ``(keep..., line, header_line)`` as columns named by their own header, and those names.

    A line's fields and its header's names are arrays by position, and a
    column takes the field where its name stands: one projection for all headers.  To the
    driver come the width of the widest header and the set of names, which is the schema.
    """
    heads = headers.distinct()
    width = heads.select(F.max(_n_fields(F.col("header_line")))).first()[0]
    if not width:
        return body, []
    named = heads.select("header_line", names(width).alias("_names"))
    first = named.select(F.posexplode("_names").alias("at", "name")).groupBy(F.lower("name").alias("k")).agg(
        F.min(F.struct("at", "name")).alias("f"))
    columns = [r["name"] for r in first.orderBy("f.at", "f.name").select("f.name").collect()]
    rows = body.join(named.withColumnRenamed("header_line", "_header"), F.col("header_line") == F.col("_header"))
    rows = rows.select(*keep, F.transform("_names", lambda n: F.lower(n)).alias("_names"), _fields(F.col("line"), width).alias("_fields"))
    return rows.select(*keep, *[F.get("_fields", F.array_position("_names", n.lower()).cast("int") - 1).alias(n) for n in columns]), columns


# --------------------------------------------------------------------------
# SRC3 JSON record envelopes, SRC5 coded per-entity records
# --------------------------------------------------------------------------


def _get_path(c: Column, dotted: str) -> Column:
    for p in dotted.split("."):
        c = c.getField(p)
    return c


def read_json_records(spark: SparkSession, path, records: str = "result.records",
                      flag: str | None = "success", multiline: bool = True,
                      schema: T.StructType | str | None = None) -> DataFrame:
    """SRC3: rows of ``records`` from envelopes whose ``flag`` is true;
    columns starting with ``_`` are dropped."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    env = r.json(path)
    if flag:
        env = env.filter(F.col(flag) == F.lit(True))
    rows = env.select(F.explode(_get_path(F.col(records.split(".")[0]),
                                          ".".join(records.split(".")[1:]))
                                if "." in records else F.col(records)).alias("r")).select("r.*")
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def json_records_from_text(df: DataFrame, column: str, records: str = "result.records",
                           flag: str | None = "success", keep: Sequence[str] = ()) -> DataFrame:
    """SRC3 for envelopes held as text in a column: keep envelopes whose
    ``flag`` is true, explode ``records``, type the fields from their merged
    schema (one small aggregate), drop fields starting with ``_``."""
    env = df.select(*keep, F.try_parse_json(F.col(column)).alias("_e"))
    if flag:
        env = env.filter(F.try_variant_get(F.col("_e"), f"$.{flag}", "boolean") == F.lit(True))
    recs = env.select(*keep, F.explode(F.try_variant_get(F.col("_e"), f"$.{records}",
                                                         "array<variant>")).alias("_r"))
    schema = recs.select(F.schema_of_variant_agg(F.col("_r"))).first()[0]
    if not schema or not schema.startswith("OBJECT<") or schema == "OBJECT<>":
        return recs.select(*keep)
    typed = recs.select(*keep, F.try_variant_get(F.col("_r"), "$",
                                                 _variant_schema_to_ddl(schema)).alias("_t"))
    names = [n for n in typed.schema["_t"].dataType.names if not n.startswith("_")]
    return typed.select(*keep, *[F.col(f"_t.{n}").alias(n) for n in names])


def read_coded_records(spark: SparkSession, path, code_map: Mapping[str, str] | DataFrame,
                       code: str = "code", records: str = "response.data",
                       value: str = "value", name: str = "name", multiline: bool = False,
                       schema: T.StructType | str | None = None) -> DataFrame:
    """SRC5: per-entity JSON pages; each record gets its entity code (from
    the data or the folder name ``code=...``) and the mapped name, and
    ``value`` is coerced to a number (bad text -> NULL).  With ``schema`` (of
    the pages) the input is read once; without it Spark infers one from all pages first."""
    reader = spark.read.option("multiLine", multiline)
    env = (reader.schema(schema) if schema is not None else reader).json(path)
    head, rest = records.split(".")[0], ".".join(records.split(".")[1:])
    rows = env.select(F.col(code).cast("string").alias(code),
                      F.explode(_get_path(F.col(head), rest) if rest else F.col(head)).alias("r"))
    rows = rows.select(code, "r.*").withColumn(value, to_double(value))
    if isinstance(code_map, DataFrame):
        dim = code_map.select(F.col(code_map.columns[0]).cast("string").alias(code),
                              F.col(code_map.columns[1]).alias(name))
    else:
        # a literal map is bounded by its own size: broadcast is safe
        dim = F.broadcast(spark.createDataFrame(list(code_map.items()), f"{code} STRING, {name} STRING"))
    return rows.join(dim, code, "left")


# --------------------------------------------------------------------------
# SRC4 catalog resource pick
# --------------------------------------------------------------------------


def pick_resource(df: DataFrame, by: str = "dataset", resources: str = "resources",
                  fmt: str = "CSV", contains: str | None = None, which: str = "last",
                  name: str = "name", fmt_field: str = "format", url: str = "url") -> DataFrame:
    """SRC4: per dataset, the last / first resource of a format, optionally
    the first whose name contains a word (case-insensitive)."""
    ex = df.select(by, F.posexplode(resources).alias("pos", "res"))
    cond = F.upper(F.col(f"res.{fmt_field}")) == fmt.upper()
    if contains:
        cond = cond & F.lower(F.col(f"res.{name}")).contains(contains.lower())
    pick = F.max_by if which == "last" else F.min_by
    return (ex.filter(cond).groupBy(by)
            .agg(pick(F.struct(F.col(f"res.{name}").alias(name), F.col(f"res.{url}").alias(url)),
                      F.col("pos")).alias("_p"))
            .select(by, "_p.*"))


# --------------------------------------------------------------------------
# SRC6 tagged merge, SRC7 XML items, SRC8 GeoJSON features
# --------------------------------------------------------------------------


def read_tagged(spark: SparkSession, sources: Mapping[str, str], names: Mapping[str, str],
                reader: Callable[[SparkSession, str], DataFrame] | None = None,
                code_col: str = "region_code", name_col: str = "city") -> DataFrame:
    """SRC6: read each source, tag it with its code and name, union by name."""
    reader = reader or (lambda s, p: read_delimited(s, p, dropna=False))
    out = None
    for code, p in sources.items():
        part = reader(spark, p).withColumns({name_col: F.lit(names.get(code)),
                                             code_col: F.lit(str(code))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_tagged_files(spark: SparkSession, sources: Mapping[str, str], names: Mapping[str, str],
                      types: Mapping[str, str] | None = None, code_col: str = "region_code",
                      name_col: str = "city") -> DataFrame:
    """SRC6 in one scan, for any number of delimited sources with a header line.

    ``sources`` maps a code to a folder or file.  Every file is read as lines;
    its folder, or itself, gives the code and name by a join with the given map (as large
    as the map: broadcast), its first line the columns.  Columns that a source lacks are
    NULL; those in ``types`` are cast, bad text to NULL.  Lines must not break within quotes.
    """
    def place(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "^[a-zA-Z0-9]+:/*", "/"), "/+$", "")

    lines = _indexed_lines(spark, list(sources.values())).filter(F.trim("line") != "")
    tags = spark.createDataFrame([(p, str(k), names.get(k)) for k, p in sources.items()], "place string, code string, name string")
    tags = F.broadcast(tags.select(place(F.col("place")).alias("_place"), F.col("code").alias(code_col), F.col("name").alias(name_col)))
    heads = lines.groupBy(F.col("file").alias("_file")).agg(F.min(F.struct("block", "mid", "line")).alias("_head"))
    path = scratch_path(spark, "tagged-heads")
    heads.select("_file", F.struct("_head.block", "_head.mid").alias("_head"), F.col("_head.line").alias("header_line"),
                 F.explode(F.array(F.regexp_replace(place(F.col("_file")), "/[^/]*$", ""), place(F.col("_file")))).alias("_at")) \
        .join(tags, F.col("_at") == F.col("_place")).drop("_at", "_place").write.mode("overwrite").parquet(path)
    meta = spark.read.parquet(path)
    body = lines.join(meta, F.col("file") == F.col("_file")).filter(F.struct("block", "mid") > F.col("_head"))
    out, columns = _by_header(body, meta.select("header_line"), _header_names(F.col("header_line")), [code_col, name_col])
    typed = {c.lower(): t for c, t in (types or {}).items()}
    return out.select(*[(F.col(c).try_cast(typed[c.lower()]) if c.lower() in typed else F.col(c)).alias(c) for c in columns],
                      code_col, name_col)


def read_xml_items(spark: SparkSession, path, row_tag: str = "item",
                   numeric: Iterable[str] = ("price", "latitude", "longitude"),
                   schema: T.StructType | str | None = None) -> DataFrame:
    """SRC7: one row per ``row_tag`` element, child tags as text columns
    without namespace prefix; the listed columns become numbers.  With
    ``schema`` (text fields by tag, prefixes included) the input is read once; without it the
    tags are first collected from all of it."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    # a tag and its namespaced twin name the same field: merge them
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.split(":")[-1], []).append(c)
    df = df.select(*[(F.coalesce(*[F.col(f"`{c}`") for c in cols]) if len(cols) > 1
                      else F.col(f"`{cols[0]}`")).alias(name) for name, cols in groups.items()])
    df = df.toDF(*sanitize_names(df.columns))
    return df.withColumns({c: to_double(c) for c in numeric if c in df.columns})


def flatten_features(spark: SparkSession, path, multiline: bool = True,
                     properties: T.StructType | str | None = None) -> DataFrame:
    """SRC8: GeoJSON FeatureCollections -> properties as columns plus
    ``longitude``/``latitude`` (first point of a MultiPoint; NULL without
    geometry).  The geometry is kept as raw JSON text and read as a variant,
    so Point and MultiPoint coordinates need no common schema.  With the
    schema of the ``properties`` the input is read once; without it they are inferred from all of it first."""
    if properties is None:
        feat = spark.read.option("multiLine", multiline).json(path).schema["features"].dataType.elementType
        props = feat["properties"].dataType if "properties" in feat.names else T.StructType([])
    else:
        props = T.StructType.fromDDL(properties) if isinstance(properties, str) else properties
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", props), T.StructField("geometry", T.StringType())])))])
    f = (spark.read.schema(schema).option("multiLine", multiline).json(path)
         .select(F.explode("features").alias("f")))
    g = F.try_parse_json(F.col("f.geometry"))

    def coord(i):
        return F.coalesce(F.try_variant_get(g, f"$.coordinates[0][{i}]", "double"),
                          F.try_variant_get(g, f"$.coordinates[{i}]", "double"))
    cols = [F.col(f"f.properties.{n}").alias(n) for n in props.names]
    return f.select(*cols, coord(0).alias("longitude"), coord(1).alias("latitude"))


def _variant_schema_to_ddl(schema: str) -> str:
    """``schema_of_variant_agg`` text -> a type ``try_variant_get`` accepts
    (objects as structs, JSON decimals as doubles like the JSON reader)."""
    ddl = schema.replace("OBJECT<", "STRUCT<")
    return re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)


def flatten_feature_text(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """SRC8 for GeoJSON held as text in a column (e.g. a landed API table).

    Each FeatureCollection is parsed to a variant and its features exploded;
    the property schema is the merge over all features (one aggregate that
    returns a short type string), so properties become typed columns.
    """
    feats = df.select(*keep, F.explode(F.try_variant_get(F.try_parse_json(F.col(column)), "$.features",
                                                         "array<variant>")).alias("_f"))
    props = F.try_variant_get(F.col("_f"), "$.properties", "variant")
    schema = feats.select(F.schema_of_variant_agg(props)).first()[0]
    cols = []
    if schema and schema.startswith("OBJECT<") and schema != "OBJECT<>":
        feats = feats.withColumn("_p", F.try_variant_get(F.col("_f"), "$.properties",
                                                         _variant_schema_to_ddl(schema)))
        cols = [F.col(f"_p.{n}").alias(n) for n in feats.schema["_p"].dataType.names]
    g = "$.geometry.coordinates"

    def coord(i):
        return F.coalesce(F.try_variant_get(F.col("_f"), f"{g}[0][{i}]", "double"),
                          F.try_variant_get(F.col("_f"), f"{g}[{i}]", "double"))
    return feats.select(*keep, *cols, coord(0).alias("longitude"), coord(1).alias("latitude"))


# --------------------------------------------------------------------------
# SRC9 repeated page elements
# --------------------------------------------------------------------------

LINK_ITEM_PATTERN = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def extract_elements(df: DataFrame, html: str, pattern: str = LINK_ITEM_PATTERN,
                     cols: Sequence[str] = ("href", "text"), keep: Sequence[str] = ()) -> DataFrame:
    """SRC9: every match of ``pattern`` in the markup becomes a row; its
    capture groups become ``cols`` and ``pos`` is the match position."""
    groups = [F.regexp_extract_all(F.col(html), F.lit(pattern), i + 1).alias(c)
              for i, c in enumerate(cols)]
    zipped = F.arrays_zip(*groups)
    return (df.select(*keep, F.posexplode(zipped).alias("pos", "_m"))
            .select(*keep, "pos", *[F.col(f"_m.{c}").alias(c) for c in cols]))


# Comments, scripts and styles (to their end, or the page's), and tags that neither make a table nor break a line.
_SKIPPED = r"<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)|\z)"
_OTHER_MARKUP = rf"(?is)(?:{_SKIPPED}|<(?!(?:/?(?:table|tr|td|th)|br)(?![a-z]))[^>]*>?)|(<[^>]*>?)"
# Character references decoded in cells, and the markup standard's limit of a colspan.
_REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_MOST_COLUMNS = 1000
#: Elements folded in one part; arrays grow element by element within a part only, so a long page costs no square of its length.
_PART = 256
_CELL = "struct<table:int,tr:int,cell:int,wide:int,tall:int,text:string>"
_SLOTS = "array<struct<col:int,left:int,value:string>>"
_OUT = "struct<table:int,row:int,col:int,value:string>"


def page_tables(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """SRC9, tables: every slot of every table of a page, as ``(keep..., table, row, col, value)``.

    A page's tags and texts are taken in order, once.  A table within a cell is
    a table of its own, numbered by its opening tag, and its text is not part of the outer
    cell.  ``rowspan`` and ``colspan`` repeat a cell's text in every slot that it
    covers; where two cells claim a slot the one from above keeps it.  A rowspan of 0 reaches to
    the last row; a span that is no number counts as 1.  Rows without cells don't count.
    Rows and columns count from 0 within the table, so a table serves GRD1-3 as a sheet
    of cells.  White space is folded, the basic character references are decoded, an empty cell is NULL.

    A page is read within its own row of ``df``: nothing is shuffled, and only slots leave
    it.  A cell whose end tag is missing ends with the next cell, row or table.
    """
    return (df.select(*keep, F.explode(_place_cells(_table_cells(F.col(html)))).alias("_slot"))
            .select(*keep, F.col("_slot.table").cast("bigint").alias("table"), *[F.col(f"_slot.{c}").alias(c) for c in ("row", "col", "value")]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: the lambda of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _record(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _fold(items: Column, start: dict[str, Column], step: Callable[[Column, Column], Column], element: str,
          tidy: Callable[[Column], dict[str, Column]] = lambda acc: {}) -> Column:
    """The last state of ``step`` over ``items``: the fields of ``start``, and ``done``, all that it appended to ``out``.

    ``step`` sees ``out`` of one part of the items only and hands ``done`` on; after each part ``tidy`` may replace fields.
    """
    none = F.array().cast(f"array<{element}>")

    def part(acc: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, acc, step, lambda a: _record(
            **({c: a[c] for c in start} | tidy(a)), out=none, done=F.concat(a["done"], F.array(a["out"]))))

    def run(x: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(_PART))
        return F.aggregate(F.transform(first, lambda at: F.slice(x, at, _PART)),
                           _record(**start, out=none, done=F.array().cast(f"array<array<{element}>>")), part,
                           lambda a: _record(**{c: a[c] for c in start}, done=F.flatten(a["done"])))

    return _let(items, run)


def _table_cells(html: Column) -> Column:
    """The cells of a page's tables with their spans and raw text, in the order of their ends.

    The state is the innermost open table (table -1: none), those around it, and the end tags of tables that were
    never opened: each makes one later table tag count for nothing.
    """

    def token(t: Column) -> Column:  # the codes: 1 and 2 begin and end a table, 3 begins a row, 5 a cell, 6 breaks a line, 4 is any other end
        tag, end = F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z]+)", 1)), F.instr(t, ">")
        code = lambda x: F.when(x.isin("td", "th"), 5).when(x == "tr", 3).when(x == "table", 1).when(x == "/table", 2).when(
            x == "br", 6).otherwise(4)
        return _record(code=_let(tag, code), tok=t, text=F.when(end > 0, t.substr(end + 1, F.length(t))).otherwise(F.lit("")))

    # a tag with the text up to the next one; what comes before the first is in no table
    tags = F.regexp_extract_all(F.regexp_replace(html, _OTHER_MARKUP, "$1"), F.lit(r"(<[^>]*>?[^<]*)"), 1)
    fields = ("table", "tr", "cell", "inside", "wide", "tall", "text", "pieces")
    no_pieces = F.array().cast("array<string>")
    nothing = _record(table=F.lit(-1), tr=F.lit(0), cell=F.lit(0), inside=F.lit(False), wide=F.lit(1), tall=F.lit(1),
                      text=F.lit(""), pieces=no_pieces)

    def changed(f: Column, **new: Column) -> Column:
        return _record(**({c: f[c] for c in fields} | new))

    def joined(f: Column) -> Column:
        return F.concat(f["text"], F.array_join(f["pieces"], ""))

    def cell_of(f: Column) -> Column:
        return _record(**{c: f[c] for c in ("table", "tr", "cell", "wide", "tall")}, text=joined(f))

    def step(acc: Column, t: Column) -> Column:
        code, top, around = t["code"], acc["top"], acc["around"]
        opens, closes = (code == 1) & (acc["unopened"] == 0), (code == 2) & (top["table"] >= 0)

        def span(name: str) -> Column:
            found = F.regexp_extract(t["tok"], rf"(?i)^[^>]*?\s{name}\s*=\s*[\"']?\s*([0-9]{{1,5}})", 1)
            return F.when(found == "", F.lit(1)).otherwise(found.cast("int"))

        def more(f: Column, text: Column) -> Column:
            return F.when(f["inside"], changed(f, pieces=F.concat(f["pieces"], F.array(text)))).otherwise(f)

        return _record(
            opened=F.when(code == 1, acc["opened"] + 1).otherwise(acc["opened"]),
            unopened=(F.when(code > 2, acc["unopened"]).when(code == 1, F.greatest(acc["unopened"] - 1, F.lit(0)))
                         .when(closes, acc["unopened"]).otherwise(acc["unopened"] + 1)),
            top=(F.when(code == 6, more(top, F.concat(F.lit(" "), t["text"])))
                    .when(opens, changed(nothing, table=acc["opened"]))
                    .when(closes, more(F.element_at(around, -1), t["text"]))
                    .when((code < 3) | (top["table"] < 0), top)
                    .when(code == 5, changed(top, cell=top["cell"] + 1, inside=F.lit(True), wide=span("colspan"), tall=span("rowspan"),
                                             text=F.lit(""), pieces=F.array(t["text"])))
                    .otherwise(changed(top, tr=F.when(code == 3, top["tr"] + 1).otherwise(top["tr"]), inside=F.lit(False)))),
            around=(F.when(code > 2, around).when(opens, F.concat(around, F.array(top)))
                       .when(closes, F.slice(around, 1, F.size(around) - 1)).otherwise(around)),
            out=F.when(top["inside"] & (code > 1) & (code < 6), F.concat(acc["out"], F.array(cell_of(top)))).otherwise(acc["out"]),
            done=acc["done"])

    one_text = lambda f: changed(f, text=joined(f), pieces=no_pieces)
    start = {"opened": F.lit(0), "unopened": F.lit(0), "top": nothing, "around": F.filter(F.array(nothing), lambda f: f["inside"])}
    last = _fold(F.transform(tags, token), start, step, _CELL,
                 lambda a: {"top": one_text(a["top"]), "around": F.transform(a["around"], one_text)})
    return _let(last, lambda a: F.concat(a["done"], F.transform(
        F.filter(F.concat(a["around"], F.array(a["top"])), lambda f: f["inside"]), cell_of)))


def _place_cells(cells: Column) -> Column:
    """The slots of all tables: in each row those held from above, then each cell's from the first free column on."""

    def with_value(c: Column) -> Column:
        value = c["text"]
        for reference, char in _REFERENCES:
            value = F.replace(value, F.lit(reference), F.lit(char))
        value = F.trim(F.regexp_replace(value, r"[\s\u00A0]+", " "))
        return _record(**{k: c[k] for k in ("table", "tr", "cell", "wide", "tall")}, value=F.nullif(value, F.lit("")))

    def told(slots: Column, table: Column, row: Column) -> Column:
        return F.transform(slots, lambda s: _record(table=table, row=row, col=s["col"], value=s["value"]))

    def next_row(acc: Column, cell: Column) -> Column:
        on = acc["table"] == cell["table"]
        row = F.when(on, acc["row"] + 1).otherwise(F.lit(0))
        held = F.filter(acc["slots"], lambda h: on & (h["left"] > 0))
        above = F.transform(held, lambda h: _record(col=h["col"], left=h["left"] - 1, value=h["value"]))
        return _let(above, lambda x: _record(
            table=cell["table"], tr=cell["tr"], row=row, next=F.lit(0), above=x, slots=x,
            out=F.concat(acc["out"], told(x, cell["table"], row)), done=acc["done"]))

    def step(acc: Column, cell: Column) -> Column:
        names = ("table", "tr", "row", "next", "above", "slots", "out", "done")
        stays = (acc["table"] == cell["table"]) & (acc["tr"] == cell["tr"])
        wide = F.greatest(F.least(cell["wide"], F.lit(_MOST_COLUMNS)), F.lit(1))
        left = F.when(cell["tall"] == 0, F.lit(1 << 30)).otherwise(cell["tall"] - 1)

        def place(r: Column) -> Column:
            free = lambda c: ~F.exists(r["above"], lambda h: h["col"] == c)
            # of one column more than are held, one is free
            at = F.when(F.size(r["above"]) == 0, r["next"]).otherwise(
                F.get(F.filter(F.sequence(r["next"], r["next"] + F.size(r["above"])), free), F.lit(0)))
            slot = lambda c: _record(col=c, left=left, value=cell["value"])
            return _let(at, lambda x: _let(
                F.when(wide == 1, F.array(slot(x))).otherwise(F.transform(F.filter(F.sequence(x, x + wide - 1), free), slot)),
                lambda new: _record(**{c: r[c] for c in ("table", "tr", "row")}, next=x + wide, above=r["above"],
                                    slots=F.concat(r["slots"], new), out=F.concat(r["out"], told(new, r["table"], r["row"])),
                                    done=r["done"])))

        return _let(F.when(stays, _record(**{c: acc[c] for c in names})).otherwise(next_row(acc, cell)), place)

    none = F.array().cast(_SLOTS)
    start = {"table": F.lit(-1), "tr": F.lit(0), "row": F.lit(0), "next": F.lit(0), "above": none, "slots": none}
    return _fold(F.transform(F.sort_array(cells), with_value), start, step, _OUT)["done"]


# --------------------------------------------------------------------------
# SRC10 inline reference rows
# --------------------------------------------------------------------------

# The inline fallback rows of the reference's infrastructure
# and freight tables (name, operator, state, status/type, capacity, lat, lon).
REFINERIES = [
    ("Lytton Refinery", "Ampol", "QLD", "Operational", 109000, -27.4195, 153.1283),
    ("Altona Refinery", "Mobil/ExxonMobil", "VIC", "Operational", 90000, -37.8667, 144.8167),
    ("Kwinana Refinery", "BP", "WA", "Operational", 146000, -32.2333, 115.7667),
    ("Geelong Refinery", "Viva Energy", "VIC", "Operational", 120000, -38.1000, 144.3833),
    ("Clyde Refinery", "Shell", "NSW", "Closed 2012", 0, -33.8167, 151.0500),
    ("Port Stanvac Refinery", "Mobil", "SA", "Closed 2003", 0, -35.1000, 138.5167),
]
TERMINALS = [
    ("Port Botany Terminal", "Viva Energy", "NSW", "Import Terminal", -33.9700, 151.2200),
    ("Gore Bay Terminal", "Viva Energy", "NSW", "Import Terminal", -33.8400, 151.1700),
    ("Kurnell Terminal", "Ampol", "NSW", "Import Terminal", -34.0100, 151.2100),
    ("Webb Dock Terminal", "BP", "VIC", "Import Terminal", -37.8350, 144.9210),
    ("Yarraville Terminal", "Mobil", "VIC", "Import Terminal", -37.8117, 144.8833),
    ("Geelong Terminal", "Viva Energy", "VIC", "Refinery Terminal", -38.1000, 144.3600),
    ("Largs North Terminal", "Viva Energy", "SA", "Import Terminal", -34.7800, 138.5100),
    ("Birkenhead Terminal", "Ampol", "SA", "Import Terminal", -34.8350, 138.5000),
    ("Port Adelaide Terminal", "BP", "SA", "Import Terminal", -34.8450, 138.5050),
    ("Fremantle Terminal", "BP", "WA", "Import Terminal", -32.0500, 115.7500),
    ("Kwinana Terminal", "BP", "WA", "Refinery Terminal", -32.2367, 115.7650),
    ("Bulwer Island Terminal", "Ampol", "QLD", "Import Terminal", -27.4283, 153.1133),
    ("Pinkenba Terminal", "Viva Energy", "QLD", "Import Terminal", -27.4300, 153.1167),
    ("Lytton Terminal", "Ampol", "QLD", "Refinery Terminal", -27.4200, 153.1250),
    ("Darwin Terminal", "Viva Energy", "NT", "Import Terminal", -12.4550, 130.8550),
    ("Selfs Point Terminal", "Mobil", "TAS", "Import Terminal", -42.8600, 147.3150),
    ("Devonport Terminal", "Ampol", "TAS", "Import Terminal", -41.1767, 146.3567),
]
DEPOTS = [
    ("Somerton Depot", "Ampol", "VIC", "Distribution Depot", -37.6333, 144.9500),
    ("Spotswood Depot", "Mobil", "VIC", "Distribution Depot", -37.8300, 144.8833),
    ("Silverwater Depot", "Ampol", "NSW", "Distribution Depot", -33.8333, 151.0500),
    ("Largs North Depot", "BP", "SA", "Distribution Depot", -34.7817, 138.5083),
    ("Cavan Depot", "Ampol", "SA", "Distribution Depot", -34.8417, 138.5917),
    ("Acacia Ridge Depot", "Ampol", "QLD", "Distribution Depot", -27.5767, 153.0350),
    ("Eagle Farm Depot", "BP", "QLD", "Distribution Depot", -27.4417, 153.0833),
    ("Kewdale Depot", "Ampol", "WA", "Distribution Depot", -31.9667, 115.9500),
]
FREIGHT_MODES = [
    ("Road", 75.2, 234.5, "Diesel", 2023),
    ("Rail", 17.3, 53.9, "Diesel/Electric", 2023),
    ("Sea (Coastal)", 5.8, 18.1, "Marine Diesel", 2023),
    ("Air", 0.3, 0.9, "Jet Fuel", 2023),
    ("Pipeline", 1.4, 4.4, "N/A (gravity/electric)", 2023),
]


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """SRC10: the inline fallback tables as DataFrames."""
    site = "name STRING, operator STRING, state STRING, type STRING, latitude DOUBLE, longitude DOUBLE"
    return {
        "refineries": spark.createDataFrame(
            REFINERIES, "name STRING, operator STRING, state STRING, status STRING, "
                        "capacity_bpd BIGINT, latitude DOUBLE, longitude DOUBLE"),
        "terminals": spark.createDataFrame(TERMINALS, site),
        "depots": spark.createDataFrame(DEPOTS, site),
        "freight_modes": spark.createDataFrame(
            FREIGHT_MODES, "mode STRING, share_pct DOUBLE, tkm_billions DOUBLE, "
                           "fuel_dependency STRING, year BIGINT"),
    }


# --------------------------------------------------------------------------
# SRC11 first source that loads, SRC12 catalog
# --------------------------------------------------------------------------


def read_first(readers: Sequence[Callable[[], DataFrame]]) -> DataFrame | None:
    """SRC11: the first candidate that plans, has at least one row and decodes.

    The row check is ``limit(1)`` on the candidate.  A candidate whose text
    holds U+FFFD was read with the wrong encoding and is passed over; that
    check stops at the first such row, and reads a good candidate once.
    """
    for make in readers:
        try:
            df = make()
            texts = [F.col(f"`{f.name}`").contains("\ufffd") for f in df.schema.fields
                     if isinstance(f.dataType, T.StringType)]
            broken = F.lit(False)
            for t in texts:
                broken = broken | F.coalesce(t, F.lit(False))
            if df.limit(1).count() > 0 and (not texts or df.filter(broken).limit(1).count() == 0):
                return df
        except (AnalysisException, OSError, ValueError):
            continue
        except Exception as e:  # missing paths surface as JVM errors
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                continue
            raise
    return None


def table(spark: SparkSession, name: str) -> DataFrame:
    """SRC12: a catalog table or view."""
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    """SRC12: whether a catalog table or view resolves (metadata only)."""
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, db: str | None = None) -> DataFrame:
    """SRC12: the catalog listing as a DataFrame (``SHOW TABLES``).

    For a named database only its own tables are listed: Spark also shows
    the session's temporary views under every database, which are not part
    of the namespace.
    """
    if not db:
        return spark.sql("SHOW TABLES")
    return spark.sql(f"SHOW TABLES IN {db}").filter(~F.col("isTemporary"))
