"""Column functions: identifiers, dates, authors, categories and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: what an identifier looks like, alone or at the end of a link.
IDENTIFIER = r"(?:arxiv:|https?://arxiv\.org/abs/)?([^\s/v]+(?:v\d+)?)"


def normalise_id(raw: Column) -> Column:
    """The identifier in a raw string or link, without version; ids end at a slash or v, as the source system's do."""
    trimmed = F.trim(raw)
    found = F.regexp_extract(trimmed, IDENTIFIER, 1)
    return F.when(found != "", F.regexp_replace(found, r"v\d+$", "")).otherwise(trimmed)


def id_recency(arxiv_id: Column, as_of_month: int) -> Column:
    """1 for ids of the month ``as_of_month`` (year * 12 + month) falling to 0 in ten years; 0.5 if the id has no date."""
    head = F.regexp_extract(arxiv_id, r"^(\d{4})\.", 1)
    month = (F.substring(head, 1, 2).try_cast("int") + 2000) * 12 + F.substring(head, 3, 2).try_cast("int")
    age = F.greatest(F.lit(0), F.lit(as_of_month) - month)
    return F.when(head != "", F.greatest(F.lit(0.0), F.lit(1.0) - age / 120.0)).otherwise(F.lit(0.5))


def age_days(published: Column, as_of: str) -> Column:
    """Days from the date in the first ten characters; 365 if there is none."""
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.try_to_timestamp(F.substring(published, 1, 10), F.lit("yyyy-MM-dd")).cast("date")), F.lit(365))


def authors_list(authors: Column, most: int = 5) -> Column:
    """Comma-separated names, trimmed, empty ones dropped, the first few; a JSON array is read as such."""
    split = F.slice(F.filter(F.transform(F.split(authors, ","), lambda a: F.trim(a)), lambda a: a != ""), 1, most)
    return F.when(authors.startswith("["), json_list(authors)).otherwise(F.coalesce(split, F.array().cast("array<string>")))


def json_list(text: Column) -> Column:
    """A JSON array of strings; the empty one for null, invalid and other JSON."""
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>"), F.array().cast("array<string>"))


def category(primary_topic: Column, categories: Column) -> Column:
    first = F.split_part(F.trim(categories), F.lit(" "), F.lit(1))
    return F.coalesce(F.when(primary_topic != "", primary_topic), first, F.lit(""))


def year_of(date: Column) -> Column:
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def safe_int(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


def one_line(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))


# Fixed value: what makes a query look academic; without regard to case, any two letters in a row do.
ACADEMIC = r"(?i)(?:\d{4}\.\d{4,5}|[A-Z]{2,}|transformer|attention|neural|network|\b(?:et\s+al|arxiv)\b)"


def looks_academic(query: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    return (words > 6) & (F.regexp_count(query, F.lit(ACADEMIC)) >= 2)


def accept_rewrite(rewritten: Column, original: Column) -> Column:
    """A rewritten query without quotes around it, or the original if it is empty or over 200 characters."""
    clean = F.trim(F.btrim(F.btrim(F.trim(rewritten), F.lit('"')), F.lit("'")))
    return F.when((clean != "") & (F.length(clean) <= 200), clean).otherwise(original)


# Display classes of categories by prefix, the first that fits.
CATEGORY_CLASSES = [
    (("cs.",), "cs"), (("hep", "physics", "astro", "quant", "cond-mat"), "physics"), (("math", "stat"), "math"), (("q-bio",), "bio"), (("econ",), "econ"), (("eess",), "eess"),
]


def category_class(code: Column) -> Column:
    out = F.lit("other")
    for prefixes, name in reversed(CATEGORY_CLASSES):
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | code.startswith(p)
        out = F.when(starts, name).otherwise(out)
    return out


def author_display(authors: Column) -> Column:
    """The first three names, and et al. if there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))


def candidate_source(cluster_idx: Column, explored: Column) -> Column:
    return (
        F.when(explored, "exploration").when(cluster_idx == -1, "short_term_supplement")
        .when(cluster_idx.isNotNull(), F.concat(F.lit("cluster_"), cluster_idx.cast("string"))).otherwise("tier1_unknown")
    )


def decode_cells(cells: Column) -> Column:
    """Typed cells ``{"type", "value"}`` in a JSON array as strings; null cells are null."""
    parsed = F.from_json(cells, "array<struct<type:string,value:string>>")
    return F.transform(parsed, lambda c: F.when(c["type"] != "null", c["value"]))


def parse_entry(entry: Column) -> Column:
    """A feed entry's id, title, abstract, authors, category and publication day, from its XML."""
    flat = F.from_xml(entry, "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>")
    return F.struct(
        normalise_id(flat["id"]).alias("arxiv_id"), one_line(F.trim(flat["title"])).alias("title"), one_line(F.trim(flat["summary"])).alias("abstract"),
        F.transform(flat["author"], lambda a: a["name"]).alias("authors"), F.coalesce(flat["category"][0]["_term"], F.lit("")).alias("category"), F.substring(flat["published"], 1, 10).alias("published"),
    )
