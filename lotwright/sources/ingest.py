"""Contracts from stored documents: the best attachment, the print form where that fails, and a reason where both do.

One plan over all documents; a broken one is a row of problems and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import normalise as N
from . import pages, products
from .stored import store

# Sources of positions, steps that fail, and what is said of them.
FROM_XML, FROM_FORM = "eis-xml", "eis-html"
LOADING, READING = "загрузка", "разбор"
NO_FILE, BROKEN, NO_PRODUCTS, NO_FORM, EMPTY_FORM = (
    "нет файла контракта", "XML не разобран", "в XML нет позиций объекта закупки", "печатной формы нет", "в печатной форме нет позиций",
)


def _best(attachments: DataFrame) -> DataFrame:
    """The attachment that stands for each contract: of the best rank, of equals that with the greater name."""
    ranked = attachments.withColumn("rank", I.attachment_rank(I.clean_file_name(F.col("file")))).filter("rank >= 0")
    return ranked.groupBy("contract").agg(F.max_by(F.struct("file", "body"), F.struct("rank", "file")).alias("a")).select("contract", "a.*")


def _amended(file: Column) -> Column:
    return F.coalesce(I.clean_file_name(file).rlike(I.AMENDED_FILES), F.lit(False))


def load(contracts: DataFrame, attachments: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of the contracts, with their source, and (contract, step, reason) of those that gave none.

    `contracts` have contract, `attachments` contract, file and body, `forms` contract and html.
    """
    known = contracts.select("contract").distinct()
    files = _best(attachments.join(known, "contract", "left_semi"))
    read = files.select("contract", _amended(F.col("file")).alias("amended"), "body", products.well_formed(F.col("body")).alias("fit"))
    listed = store(products.products(read.filter("fit"), ["contract", "amended"], "body"), "ingest-products")
    done = listed.select("contract").distinct().withColumn("done", F.lit(True))
    why = read.select("contract", F.when(F.col("fit"), NO_PRODUCTS).otherwise(BROKEN).alias("why"))
    left = known.join(done, "contract", "left_anti").join(why, "contract", "left").withColumn("why", F.coalesce("why", F.lit(NO_FILE)))
    left = store(left.join(forms.select("contract", "html"), "contract", "left"), "ingest-left")
    formed = left.filter("html is not null").select("contract", F.posexplode(pages.print_form(F.col("html"))).alias("at", "p"))
    formed = store(formed.select("contract", F.col("at").cast("long").alias("at"), "p.*"), "ingest-forms")
    columns = ("contract", "source", "amended", "line", "name", "ktru", "unit", "quantity", "price", "total")
    from_xml = listed.select("*", F.lit(FROM_XML).alias("source")).select(*columns)
    from_form = formed.select("*", F.lit(FROM_FORM).alias("source"), F.lit(False).alias("amended"), (F.col("at") + 1).alias("line"), N.blank_to_null(F.col("code")).alias("ktru")).select(*columns)
    failed = left.join(formed.select("contract").distinct(), "contract", "left_anti")
    missing = F.col("html").isNull()
    problems = failed.select(
        "contract", F.when(missing, LOADING).otherwise(READING).alias("step"), F.concat_ws("; ", "why", F.when(missing, NO_FORM).otherwise(EMPTY_FORM)).alias("reason")
    )
    return from_xml.unionByName(from_form), problems
