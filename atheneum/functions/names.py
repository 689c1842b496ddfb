"""File names that carry fields, misspellings, globs and labels of names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of document types, misspellings, fields of the keyword text.
DOC_TYPES = {
    "proposal": "Proposal", "report": "Report", "minutes": "Minutes", "mom": "Minutes", "contract": "Contract", "agreement": "Agreement", "sow": "SOW",
    "spec": "Specification", "specification": "Specification", "presentation": "Presentation", "deck": "Presentation", "slides": "Presentation",
    "quote": "Quotation", "quotation": "Quotation", "invoice": "Invoice", "po": "Purchase Order", "rfp": "RFP", "rfq": "RFQ", "nda": "NDA", "memo": "Memo",
    "brief": "Brief", "summary": "Summary", "plan": "Plan", "roadmap": "Roadmap", "review": "Review", "notes": "Notes", "draft": "Draft",
}
TYPOS = {"challanges": "Challenges", "methology": "Methodology", "discssion": "Discussion", "additonal": "Additional", "valudation": "Validation"}
KEYWORD_FIELDS = ["clean_name", "client", "product", "topic", "doc_type", "version", "doc_ids", "document_title", "section_path", "folder"]
IDS = r"^(\d+(?:-\d+)*)\b\s*"
VERSION_WORD = r"(?i)^v\d+(\.\d+)*$"


def filename_fields(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """df with doc_ids, version, doc_type, originator, client, product, topic (null where absent), terms, clean_name and tokens.

    Fields lie between underscores. The first version and the first document type are taken out of them; an
    upper-case first term of up to five characters is the originator if others follow. Null names count as empty."""
    types = F.create_map(*(F.lit(x) for x in chain.from_iterable(DOC_TYPES.items())))
    at = lambda words, test: F.array_position(F.transform(words, test), F.lit(True)) - 1
    c = F.col
    df = df.withColumn("_stem", F.trim(F.regexp_replace(F.coalesce(file_name, F.lit("")), r"^(\.*[^.].*)\.[^.]*$", "$1")))
    df = df.withColumn("_fields", F.filter(F.transform(F.split(F.regexp_replace("_stem", IDS, ""), "_+"), lambda x: F.trim(x)), lambda x: x != ""))
    df = df.withColumn("_v", at(c("_fields"), lambda x: x.rlike(VERSION_WORD))).withColumn("_d", at(c("_fields"), lambda x: types[F.lower(x)].isNotNull()))
    df = df.withColumn("_terms", F.filter("_fields", lambda x, i: (i != c("_v")) & (i != c("_d"))))
    first = F.get("_terms", F.lit(0))
    code = (F.size("_terms") > 1) & (F.length(first) <= 5) & (first == F.upper(first)) & (first != F.lower(first))
    df = df.withColumn("originator", F.when(code, first)).withColumn("terms", F.when(code, F.slice("_terms", 2, 1 << 20)).otherwise(c("_terms")))
    rest = F.slice("terms", 3, 1 << 20)
    out = {
        "doc_ids": F.nullif(F.regexp_extract("_stem", IDS, 1), F.lit("")), "version": F.lower(F.get("_fields", F.when(c("_v") >= 0, c("_v")).cast("int"))),
        "doc_type": types[F.lower(F.get("_fields", F.when(c("_d") >= 0, c("_d")).cast("int")))], "client": F.get("terms", F.lit(0)), "product": F.get("terms", F.lit(1)),
        "topic": F.when(F.size(rest) > 0, F.array_join(rest, " ")), "clean_name": F.trim(F.regexp_replace("_stem", r"[_\-]+", " ")),
        "tokens": F.filter(F.split("_stem", r"[\s_\-]+"), lambda x: x != ""),
    }
    return df.withColumns(out).drop("_stem", "_fields", "_v", "_d", "_terms")


def keyword_text(fields: dict[str, Column], body: Column) -> Column:
    """The fields that are not blank, in a fixed order, on a line above the body."""
    line = F.concat_ws(" ", *(F.when(fields[f] != "", fields[f]) for f in KEYWORD_FIELDS if f in fields))
    return F.when(line != "", F.concat(line, F.lit("\n"), body)).otherwise(body)


def corrected(name: Column, typos: dict[str, str] = TYPOS) -> Column:
    """The name with its first known misspelling (in the table's order) corrected wherever it occurs; null if it has none."""
    return F.coalesce(*(F.when(F.lower(name).contains(bad), F.regexp_replace(name, rf"(?i)\Q{bad}\E", good)) for bad, good in typos.items()))


def glob_match(path: Column, glob: str) -> Column:
    """Shell-style match of a whole path: * and ? also cross slashes, [..] and [!..] are sets."""
    out, k = "", 0
    while k < len(glob):
        end = glob.find("]", k + 2) if glob[k] == "[" else -1
        if end > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(glob[k], glob[k] if glob[k].isalnum() else "\\" + glob[k] if glob[k].isascii() else glob[k])
        k += 1
    return path.rlike(f"(?s)^{out}\\z")


def without_number(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"^[0-9]{1,3}[._ -]+", "")


def humanized(name: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(name, "^[0-9]{2}[_ -]", ""), F.lit("_"), F.lit(" ")))


def project_id(year: Column, code: Column) -> Column:
    return F.concat_ws("-", F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("XXXX")), F.replace(code, F.lit("_"), F.lit("-")))
