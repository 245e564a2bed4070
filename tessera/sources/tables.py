"""Tables by file extension, structure-data files, measurement databases, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.duplicates import check_unit_error, mad_duplicates, value_stats
from tessera.session import materialize

READERS = {
    "csv": lambda r, p: r.option("header", True).option("inferSchema", True).csv(p),
    "tsv": lambda r, p: r.option("header", True).option("inferSchema", True).option("sep", "\t").csv(p),
    "parquet": lambda r, p: r.parquet(p),
    "json": lambda r, p: r.json(p),
    "orc": lambda r, p: r.orc(p),
}
WRITERS = {
    "csv": lambda w, p: w.option("header", True).csv(p),
    "tsv": lambda w, p: w.option("header", True).option("sep", "\t").csv(p),
    "parquet": lambda w, p: w.parquet(p),
    "json": lambda w, p: w.json(p),
    "orc": lambda w, p: w.orc(p),
}


def _kind(path: str, known: dict) -> str:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in known:
        raise ValueError(f"no table format for the extension: {path}")
    return kind


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """The table at path; csv, tsv, parquet, json or orc by extension. xlsx goes through the driver."""
    if path.lower().endswith(".xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options))
    reader = spark.read.options(**options)
    return READERS[_kind(path, READERS)](reader.schema(schema) if schema else reader, path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", **options) -> bool:
    """Write by extension; an empty frame writes nothing and gives False."""
    kind = _kind(path, WRITERS)
    if df.isEmpty():
        return False
    WRITERS[kind](df.write.mode(mode).options(**options), path)
    return True


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(title, molblock, properties): one row per record of structure-data files, split by their separator."""
    rows = spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "")
    named = F.regexp_extract_all("value", F.lit(r">\s*<([^>]+)>[^\n]*\n"), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(r">\s*<[^>]+>[^\n]*\n((?:(?!\n\n|\n>).)*(?:\n(?!\n|>)[^\n]*)*)"), F.lit(1)), lambda v: F.trim(v))
    return rows.select(F.trim(F.split("value", "\n")[0]).alias("title"), F.regexp_extract("value", r"(?s)^(.*?M  END)", 1).alias("molblock"), F.map_from_arrays(F.array_distinct(named), F.slice(values, 1, F.size(F.array_distinct(named)))).alias("properties"))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become null in every string column."""
    return df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def parse_affinity(value: Column) -> Column:
    """struct(Value, Unit, Relation) of text such as ">1500" in nM: the value in uM, null if not a number."""
    text = F.trim(value)
    relation = F.when(F.substring(text, 1, 1).isin("<", ">"), F.substring(text, 1, 1)).otherwise("=")
    number = F.regexp_replace(text, "^[<>]", "").try_cast("double") / 1000.0
    return F.struct(number.alias("Value"), F.lit("uM").alias("Unit"), relation.alias("Relation"))


def p_value(micromolar: Column) -> Column:
    """-log10 of a concentration in uM expressed in M; null unless positive."""
    return F.when(micromolar > 0, -F.log10(micromolar / 1e6))


def _resolved(df: DataFrame, key: str, value: str, range_threshold: float, z_threshold: float) -> DataFrame:
    """One row a key. Screen and resolution share one pass over the rows, which gives the bounds and the mean of each key."""
    stats, _ = materialize(value_stats(df, key, value), "key-stats")
    wrong = check_unit_error(df, key, value, stats=stats).where("unit_error").select(F.col(key).alias("__w"))
    clean = df.join(wrong, F.col(key) == F.col("__w"), "left_anti")
    right = stats.join(wrong, F.col("k") == F.col("__w"), "left_anti")
    return mad_duplicates(clean, key, value, range_threshold, z_threshold, right).where(F.col(value).isNotNull()).dropDuplicates([key])


def preprocess_binding(df: DataFrame, activity: str = "IC50 (nM)", key: str = "Ligand InChI Key", target: str = "Target Name", range_threshold: float = 1.0, z_threshold: float = 3.5) -> DataFrame:
    """Exact measurements of a binding table, one row a molecule and target: parsed, in pIC50, screened for
    mistaken units, repeated ones resolved."""
    rows = blank_to_null(df).dropna(subset=[activity, key])
    parsed = rows.withColumn("__a", parse_affinity(F.col(activity))).select("*", "__a.*").drop("__a")
    exact = parsed.where("Relation = '='").withColumn("pIC50", p_value(F.col("Value"))).where("pIC50 is not null")
    keyed = exact.withColumn("dd_key", F.concat_ws("|", key, target))
    return _resolved(keyed, "dd_key", "pIC50", range_threshold, z_threshold)


# Columns of an activity export that go, new names of those that stay, words that mark a protein variant.
ACTIVITY_DROPPED = (
    "Molecule Max Phase", "Molecular Weight", "#RO5 Violations", "AlogP", "Ligand Efficiency BEI", "Ligand Efficiency LE", "Ligand Efficiency LLE",
    "Ligand Efficiency SEI", "Compound Key", "Source Description", "Document Journal", "Uo Units", "Cell ChEMBL ID", "Properties", "Action Type",
    "Standard Text Value", "Value", "Potential Duplicate", "Comment", "BAO Format ID", "BAO Label", "Target Organism",
)
ACTIVITY_NAMES = {
    "Molecule ChEMBL ID": "ID_Mol", "Molecule Name": "Name", "Smiles": "SMILES", "Standard Relation": "Relation", "Standard Type": "Type",
    "Standard Value": "Value", "Standard Units": "Units", "Assay ChEMBL ID": "ID_Assay", "Target ChEMBL ID": "ID_Target",
    "pChEMBL Value": "pChEMBL_Value", "Assay Description": "Assay_Desc", "Assay Type": "Assay_Type", "Target Name": "Target",
    "Document Year": "Year", "Data Validity Comment": "Validity", "Target Type": "Type_Target", "Document ChEMBL ID": "Document",
    "Source ID": "ID_Source", "Assay Variant Accession": "Assay_Variant_Accession", "Assay Variant Mutation": "Assay_Variant_Mutation",
    "Assay Tissue ChEMBL ID": "Assay_Tissue_ID", "Assay Tissue Name": "Assay_Tissue_Name", "Assay Subcellular Fraction": "Assay_Subcellular",
    "Assay Parameters": "Assay_Parameters", "Assay Organism": "Assay_Organism", "Assay Cell Type": "Assay_Cell_Type",
}
VARIANT_WORDS = ("mutant", "mutation", "variant")


def preprocess_chembl(df: DataFrame, activity_type: str = "IC50", range_threshold: float = 1.0, z_threshold: float = 3.5) -> DataFrame:
    """Exact, valid human single-protein measurements of one type, one row a molecule and target.

    Columns keep the names of ACTIVITY_NAMES; descriptions that speak of a protein variant exclude a
    row. The key is the molecule string and target; mistaken units are screened, repeats resolved. An
    empty result has the full schema.
    """
    if "Standard Value" in df.columns:
        df = df.drop(*ACTIVITY_DROPPED)
    rows = blank_to_null(df.withColumnsRenamed({old: new for old, new in ACTIVITY_NAMES.items() if old in df.columns}))
    rows = rows.withColumns({"Relation": F.regexp_replace("Relation", "^'+|'+$", ""), "Value": F.col("Value").try_cast("double"), "pChEMBL_Value": F.col("pChEMBL_Value").try_cast("double"), "Assay_Desc": F.lower(F.trim("Assay_Desc"))})
    kept = rows.where((F.col("Type") == activity_type) & (F.col("Relation") == "=") & F.col("Validity").isNull() & (F.col("Units") == "nM") & (F.col("Type_Target") == "SINGLE PROTEIN") & F.col("pChEMBL_Value").isNotNull() & (F.col("Assay_Organism") == "Homo sapiens"))
    plain = kept.where(~F.coalesce(F.col("Assay_Desc"), F.lit("")).rlike("|".join(VARIANT_WORDS)))
    keyed = plain.withColumn("dd_key", F.concat_ws("|", "SMILES", "ID_Target") if "ID_Target" in plain.columns else F.col("SMILES"))
    return _resolved(keyed, "dd_key", "pChEMBL_Value", range_threshold, z_threshold)


#: Where an article's fields are in its XML.
ARTICLE = {"title": "//article-title", "journal": "//journal-title", "publisher": "//publisher-name", "doi": "//article-id[@pub-id-type='doi']", "pmid": "//article-id[@pub-id-type='pmid']", "year": "//pub-date/year", "month": "//pub-date/month", "day": "//pub-date/day", "volume": "//volume", "issue": "//issue"}


def article_fields(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Adds the fields of ARTICLE ("" where missing), the abstract's text and the sorted distinct keywords."""
    fields = {n: F.coalesce(F.expr(f"xpath_string(`{xml_col}`, \"{p}\")"), F.lit("")) for n, p in ARTICLE.items()}
    abstract = F.trim(F.regexp_replace(F.array_join(F.expr(f"xpath(`{xml_col}`, '//abstract//text()')"), " "), r"\s+", " "))
    keywords = F.array_sort(F.array_distinct(F.expr(f"xpath(`{xml_col}`, '//kwd/text()')")))
    return df.withColumns({**fields, "abstract": F.coalesce(abstract, F.lit("")), "keywords": keywords})


def id_conversion(json: Column) -> Column:
    """struct(pmcid, pmid, doi) of the first record of an id service's answer."""
    return F.struct(*[F.get_json_object(json, f"$.records[0].{k}").alias(k) for k in ("pmcid", "pmid", "doi")])


def html_fields(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title, n_links and n_paragraphs of an HTML page, by patterns: pages are not XML."""
    page = F.coalesce(F.col(html_col), F.lit(""))
    return df.withColumns({"title": F.trim(F.regexp_extract(page, r"(?i)<title>([^<]*)</title>", 1)), "n_links": F.regexp_count(page, F.lit(r"(?i)<a\s")).cast("long"), "n_paragraphs": F.regexp_count(page, F.lit(r"(?i)<p[>\s]")).cast("long")})


def resolve(df: DataFrame, name_col: str, fetch, out: str = "resolved", enabled: bool = False) -> DataFrame:
    """df with fetch(list of names) -> {name: text}, called once a batch of distinct names. Off by default, as it
    reaches services."""
    if not enabled:
        raise RuntimeError("resolvers reach outside services; pass enabled=True and a fetch function")
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            got = fetch(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([got.get(n) for n in names], pa.string())], ["__name", "__got"])

    looked = df.select(F.col(name_col).cast("string").alias("__n")).where("__n is not null").distinct().mapInArrow(work, "__name string, __got string")
    return df.join(looked, F.col(name_col) == F.col("__name"), "left").withColumn(out, F.col("__got")).drop("__name", "__got")


def read_dock_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, score, parameters): the least affinity of each docking log and its `< name > : < value >` lines."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    scores = F.transform(F.regexp_extract_all("value", F.lit(r"Affinity:\s*([\-?+\d.]+)\s+\(kcal/mol\)"), F.lit(1)), lambda x: x.try_cast("double"))
    pairs = lambda i: F.regexp_extract_all("value", F.lit(r"(?m)^<\s(.+)\s>\s:\s<\s(.+)\s>$"), F.lit(i))
    return logs.select("path", F.array_min(scores).alias("score"), F.map_from_entries(F.arrays_zip(pairs(1), pairs(2))).alias("parameters"))


def article_tokens(df: DataFrame) -> DataFrame:
    """Adds tokens of the abstract, words of letters without stop words, and keeps keywords sorted and distinct.

    Needs the columns of article_fields.
    """
    return df.withColumn("tokens", tokenize(F.col("abstract"))).withColumn("keywords", F.array_sort(F.array_distinct("keywords")))
