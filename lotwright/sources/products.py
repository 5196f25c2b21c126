"""Every field of a contract's products, by built-in expressions that no document can break.

A product's node is cut out as text, its prefixes go, and its nested blocks are read
and then taken out of it, so that a name or code is never read from another's block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions import normalise as N
from ..functions.identifiers import every, is_trademark
from .contract_xml import specs_text

# The blocks within a product, and the signs of strict limits.
BLOCKS = ("KTRUInfo", "OKPD2Info", "medicalProductInfo", "characteristics", "OKEIInfo", "VATRateInfo", "originCountryInfo")
STRICT = {"greater": ">", "less": "<"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _plain(xml: Column) -> Column:
    """A document without comments, prefixes and the declarations that bind them."""
    bare = F.when(F.contains(xml, F.lit("<!--")), F.regexp_replace(xml, r"(?s)<!--.*?-->", "")).otherwise(xml)
    return F.regexp_replace(F.regexp_replace(bare, r"(</?)[\w.-]+:", "$1"), r'\s+xmlns(?::[\w.-]+)?="[^"]*"', "")


def _node(name: str) -> str:
    return rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>"


def block(xml: Column, name: str) -> Column:
    """The inside of the first element of a name; empty if there is none."""
    return F.regexp_extract(F.coalesce(xml, F.lit("")), _node(name), 1)


def field(xml: Column, *names: str) -> Column:
    """The text of the first of several elements that has any, entities read; null if none has."""

    def one(name: str) -> Column:
        raw = F.regexp_extract(F.coalesce(xml, F.lit("")), rf"<{name}(?:\s[^>]*)?>([^<]*)</{name}>", 1)
        for written, sign in ENTITIES.items():
            raw = F.replace(raw, F.lit(written), F.lit(sign))
        # worked out once, in expressions of arrays too
        return F.get(F.filter(F.array(N.tidy(raw)), lambda t: t != ""), F.lit(0))

    return F.coalesce(*[one(n) for n in names])


def without(xml: Column, *names: str) -> Column:
    for name in names:
        xml = F.regexp_replace(xml, _node(name), "")
    return xml


def _edge(spread: Column, side: str) -> Column:
    """A limit of a range, a strict one with its sign."""
    sign = F.create_map(*[F.lit(x) for pair in STRICT.items() for x in pair])
    limit = F.struct(field(spread, side).alias("number"), field(spread, f"{side}MathNotation").alias("note"))
    return N.let(limit, lambda x: F.when(x["number"].isNotNull(), F.concat_ws(" ", sign[x["note"]], x["number"])))


def _value(value: Column) -> Column:
    """A characteristic's value: words, or a number or range with its unit."""
    parts = F.struct(block(value, "OKEI").alias("unit"), block(value, "valueRange").alias("spread"))
    told = lambda p: M.value_text(field(value, "qualityDescription"), field(value, "concreteValue"), _edge(p["spread"], "min"), _edge(p["spread"], "max"), F.coalesce(field(p["unit"], "nationalCode", "name"), F.lit("")))
    return N.let(parts, told)


def characteristics(product: Column) -> Column:
    """Names and values of a product's characteristics; several values of one are joined, of equal names the first stays."""
    nodes = every(product, r"(?s)<(characteristicsUsing\w*)(?:\s[^>]*)?>.*?</\1>")

    def one(node: Column) -> Column:
        values = F.filter(F.transform(every(node, r"(?s)<value(?:\s[^>]*)?>(?:(?!<value[\s>]).)*?</value>"), _value), lambda v: v != "")
        return F.struct(F.regexp_replace(F.coalesce(field(without(node, "value", "values"), "name"), F.lit("")), "[ \t:;]+$", "").alias("name"), F.array_join(values, ", ").alias("value"))

    some = F.filter(F.transform(nodes, one), lambda s: (s["name"] != "") & (s["value"] != ""))
    first = lambda all_: F.filter(all_, lambda s, i: F.array_position(F.transform(all_, lambda t: F.lower(t["name"])), F.lower(s["name"])) == i + 1)
    return N.let(some, first)


def well_formed(xml: Column) -> Column:
    """Whether a document can be read as XML at all."""
    read = F.from_xml(xml, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(xml.isNotNull() & (F.trim(xml) != "") & read["_corrupt_record"].isNull(), F.lit(False))


def product_nodes(xml: Column) -> Column:
    """Products of a document; without any, the products or subjects of old forms that have a code or a price."""
    text = _plain(F.coalesce(xml, F.lit("")))
    found = lambda t, name: every(t, _node(name), 1)
    old = lambda t, name: F.filter(found(t, name), lambda n: n.rlike("<KTRUInfo[\\s>]|<price[\\s>]"))

    def first(t: Column) -> Column:
        # old forms are looked for only where there is nothing else
        older = N.let(F.struct(old(t, "product").alias("product"), t.alias("t")), lambda x: F.when(F.size(x["product"]) > 0, x["product"]).otherwise(old(x["t"], "contractSubjectInfo")))
        return N.let(F.struct(found(t, "productInfo").alias("new"), t.alias("t")), lambda x: F.when(F.size(x["new"]) > 0, x["new"]).otherwise(older))

    return N.let(text, first)


def products(documents: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """`keys` and a row for each product of a document: its place, names, codes, characteristics, unit, amounts, tax, country and mark."""
    cut = documents.select(*keys, F.posexplode(product_nodes(F.col(xml))).alias("at", "node"))
    node = F.col("node")
    inside = {b: block(node, b) for b in BLOCKS}
    cut = cut.withColumns({b: x for b, x in inside.items()} | {"own": without(node, *BLOCKS)}).withColumn("specs", characteristics(node))
    own = F.col("own")
    # a code's own name is not that of what it stands in
    ktru, medical = F.col("KTRUInfo"), F.col("medicalProductInfo")
    number = F.replace(F.replace(field(own, "quantity"), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    cut = cut.withColumns({"_price": N.money(field(own, "price")), "_quantity": number, "_place": field(own, "indexNum"), "_said": field(node, "tradeMark", "trademark")})
    price, quantity, place, said = (F.col(c) for c in ("_price", "_quantity", "_place", "_said"))
    mark = N.let(F.struct(said.alias("said"), M.clean_trademark(said).alias("clean")), lambda x: F.when(is_trademark(x["clean"]), x["clean"]).when(is_trademark(x["said"]), x["said"]))
    return cut.select(
        *keys, F.coalesce(F.when(place.rlike(r"^\d{1,9}$"), place.cast("long")), F.col("at") + 1).alias("line"),
        F.coalesce(field(own, "name"), field(ktru, "name")).alias("name"), field(ktru, "code").alias("ktru"), field(ktru, "name").alias("ktru_name"), field(F.col("OKPD2Info"), "OKPDCode").alias("okpd2"),
        F.coalesce(F.lower(field(medical, "isMedicalProductInfo")) == "true", F.lit(False)).alias("is_medical"), field(medical, "medicalProductCode").alias("nkmi"), field(medical, "medicalProductName").alias("nkmi_name"),
        field(medical, "certificateNameMedicalProduct").alias("ru_name"), F.transform("specs", lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"))).alias("specs"), specs_text(F.col("specs")).alias("specs_text"),
        field(F.col("OKEIInfo"), "nationalCode", "name").alias("unit"), quantity.alias("quantity"), price.alias("price"), F.coalesce(N.money(field(own, "sum")), F.round(price * quantity, 2)).alias("total"),
        field(F.col("VATRateInfo"), "VATName", "VATCode").alias("vat"), field(F.col("originCountryInfo"), "countryFullName", "countryCode").alias("country"),
        mark.alias("trademark"),
    )
