"""JSON documents against a schema and rules, side-cars against what is expected, stored figures against computed ones.

A bad document is a row of the violations, never a failed scan: the others are read all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DocumentSchema:
    """Fields with their types, those that must be there, and rules: conditions in SQL on the fields, by name."""

    fields: str
    required: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(self.fields)


VIOLATION = "rule string, field string, value string"


def _violations(text: Column, doc: Column, schema: DocumentSchema) -> Column:
    """What is wrong with a document: it is no JSON object, or fields are missing, unknown or of another type, or rules don't hold."""
    keys = F.json_object_keys(text)
    row = lambda rule, name, value: F.struct(F.lit(rule).alias("rule"), (F.lit(name) if isinstance(name, str) else name).alias("field"), value.cast("string").alias("value"))
    none = F.lit(None)
    found = [F.transform(F.filter(keys, lambda k: ~k.isin(*schema.struct.names)), lambda k: row("unknown", k, none))]
    for f in schema.struct:
        given = F.get_json_object(text, f"$.{f.name}")
        if f.name in schema.required:
            found.append(F.when(~F.array_contains(keys, f.name) | given.isNull(), F.array(row("missing", f.name, none))).otherwise(F.array()))
        found.append(F.when(given.isNotNull() & doc[f.name].isNull(), F.array(row("type", f.name, given))).otherwise(F.array()))
    for name, condition in schema.rules:
        # a rule that can't be decided, as a field is missing or of another type, is not broken besides
        found.append(F.when(~F.expr(condition), F.array(row(name, none, F.to_json(doc)))).otherwise(F.array()))
    return F.when(keys.isNull(), F.array(row("malformed", none, F.substring(text, 1, 200)))).otherwise(F.concat(*found)).cast(f"array<struct<{VIOLATION.replace(' string', ': string')}>>")


def checked(rows: DataFrame, text: str, schema: DocumentSchema) -> DataFrame:
    """rows plus the documents' fields and ``violations``, an array of (rule, field, value) that is empty for a good one."""
    # another type makes only its own field null
    each = {f.name: F.from_json(F.col(text), T.StructType([f]))[f.name] for f in schema.struct}
    named = rows.withColumns(each)
    return named.withColumn("violations", _violations(F.col(text), F.struct(*schema.struct.names), schema))


def violations(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, field, value): a row for each violation of ``checked`` documents."""
    return found.select(*keys, F.explode("violations").alias("v")).select(*keys, "v.*")


def document_files(spark: SparkSession, path: str, schema: DocumentSchema) -> DataFrame:
    """(file, text, fields, violations) of the JSON files below path, each one document; an empty file has no row (see ``completeness``)."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return checked(text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), "text", schema)


def found_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path below root, size) of the files below a folder that hold anything, whose contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    return files.select(F.expr(f"substring_index(path, '{base.rstrip('/')}/', -1)").alias("path"), F.col("length").alias("size"))


def completeness(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of expected (path) against found (path, size) files: missing (or empty), or unexpected."""
    both = expected.select("path", F.lit(True).alias("_wanted")).join(found, "path", "full")
    problem = F.when(F.col("_wanted").isNull(), "unexpected").when(F.coalesce(F.col("size"), F.lit(0)) == 0, "missing")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def side_car_audit(spark: SparkSession, root: str, expected: DataFrame, schema: DocumentSchema, glob: str = "*.json") -> DataFrame:
    """(path, problem) of the side-cars below root: incomplete ones by name and size, and what is wrong in those that are there."""
    found = found_files(spark, root, glob)
    docs = document_files(spark, root, schema)
    inside = violations(docs, ["file"]).select(F.element_at(F.split("file", "/"), -1).alias("path"), F.concat_ws(":", "rule", "field").alias("problem"))
    return completeness(expected, found).unionByName(inside)


def differences(stored: DataFrame, computed: DataFrame, keys: list[str], figures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, problem, figure, stored, computed): records that are missing or surplus in ``stored``, and figures that differ by more than the tolerance.

    Null and NaN equal each other; repeated stored records are surplus.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    sides = []
    for name, df in (("stored", stored), ("computed", computed)):
        one = df.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"), *(F.min(value(c)).alias(f"{name}_{c}") for c in figures))
        sides.append(one.withColumnsRenamed({k: f"{name}_{k}" for k in keys}))
    same = None
    for k in keys:
        on = F.col(f"stored_{k}").eqNullSafe(F.col(f"computed_{k}"))
        same = on if same is None else same & on
    both = sides[0].join(sides[1], same, "full")
    n, m = F.coalesce("stored_n", F.lit(0)), F.coalesce("computed_n", F.lit(0))
    null = F.lit(None).cast("double")
    row = lambda problem, figure, a, b: F.struct(F.lit(problem).alias("problem"), F.lit(figure).cast("string").alias("figure"), a.alias("stored"), b.alias("computed"))
    parts = [F.when(n < m, F.array(row("missing", None, null, null))).when(n > m, F.array(row("surplus", None, null, null))).otherwise(F.array())]
    for c in figures:
        a, b = F.col(f"stored_{c}"), F.col(f"computed_{c}")
        off = F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())
        parts.append(F.when((n > 0) & (m > 0) & off, F.array(row("differs", c, a, b))).otherwise(F.array()))
    kind = "array<struct<problem: string, figure: string, stored: double, computed: double>>"
    named = both.select(*(F.coalesce(f"stored_{k}", f"computed_{k}").alias(k) for k in keys), F.explode(F.concat(*(p.cast(kind) for p in parts))).alias("d"))
    return named.select(*keys, "d.*")
