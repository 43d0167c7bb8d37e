"""Personal data: regular expressions propose spans, checksums confirm them, words nearby change the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.quality import let

# The spans that are always reported. The e-mail and ip patterns start where
# a run of their characters starts or the last match ended, since a match from inside a run
# ends as one from its start would; possessive repeats keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IS_IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
# What the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NUMBER = r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20./-]?[0-9]){6,14}(?![0-9A-Za-z-])"
CONTEXT = {
    "iban": "iban|konto|account|bank|compte|cuenta",
    "phone": "phone|call|tel|mobile|fax|telefon|téléphone|teléfono|rufnummer",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
}
KINDS = ["email", "ip", "card", "phone", "iban"]
NEAR = 40
#: Matches of a text that are placed together.
GROUP = 256


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: what lies between matches, from the same search, gives the starts. Places are code points."""

    kind = "array<struct<start:int,end:int,s:string>>"

    def wide(both: Column, i: Column) -> Column:
        return F.length(F.get(both["g"], i)) + F.length(F.get(both["m"], i))

    def group(both: Column, first: Column, at: Column) -> Column:
        """The places of the matches from first on, as many as a group has; at is where the text before them ends."""
        return F.aggregate(
            F.sequence(first, F.least(first + GROUP, F.size(both["m"])) - 1),
            F.struct(at.alias("at"), F.array().cast(kind).alias("out")),
            lambda s, i: F.struct((s["at"] + wide(both, i)).alias("at"), F.array_append(s["out"], F.struct((s["at"] + F.length(F.get(both["g"], i))).alias("start"), (s["at"] + wide(both, i)).alias("end"), F.get(both["m"], i).alias("s"))).alias("out")),
            lambda s: s["out"],
        )

    def placed(both: Column) -> Column:
        """In groups, since appending to an array copies it: the groups' widths are added up first."""
        firsts = F.sequence(F.lit(0), F.size(both["m"]) - 1, F.lit(GROUP))
        widths = F.transform(firsts, lambda k: F.aggregate(F.sequence(k, F.least(k + GROUP, F.size(both["m"])) - 1), F.lit(0), lambda n, i: n + wide(both, i)))
        starts = F.aggregate(widths, F.array(F.lit(0)), lambda out, w: F.array_append(out, F.element_at(out, -1) + w))
        return let(starts, lambda ats: F.flatten(F.transform(firsts, lambda k, nth: group(both, k, F.get(ats, nth)))))

    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(found, lambda b: F.when(F.size(b["m"]) == 0, none).otherwise(placed(b)))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn sum."""
    d = F.reverse(digits(s))
    each = F.transform(F.split(d, "(?<=.)(?=.)"), lambda x, i: let(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an IBAN's number, its first four characters moved to the end and letters as 10 to 35, leaves 1 over 97."""
    plain = F.regexp_replace(s, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "(?<=.)(?=.)")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string")).cast("int")
    return F.aggregate(chars, F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def near(text: Column, span: Column, kind: str) -> Column:
    before = F.greatest(span["start"] - NEAR, F.lit(0))
    return F.lower(text.substr(before + 1, span["start"] - before)).rlike(CONTEXT[kind]) | F.lower(text.substr(span["end"] + 1, F.lit(NEAR))).rlike(CONTEXT[kind])


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans of personal data: doc_id and, for each kind, an array of (start, end, score).

    Base spans (e-mail, ip, card with Luhn, phone with + and 8 to 15 digits) always stay.
    Added: IBANs (0.9 if mod 97 holds, else 0.2), cards of 12 to 15 digits (0.4 with Luhn) and
    numbers of 8 to 15 digits without + as phones (0.3); a context word within 40
    characters adds 0.3; spans of the threshold or more stay if no base span and no added span of a surer kind (card, iban, phone) overlaps them.

    A null text is empty and has no spans; rows that share a doc_id stay rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    has_digit = F.col("t").rlike("[0-9]")
    when = lambda test, value: F.when(test, value).otherwise(none)
    n_digits = lambda x: F.length(digits(x["s"]))
    d = docs.select("doc_id", t.alias("t"))
    d = d.select(
        "doc_id",
        "t",
        when(F.col("t").contains("@"), spans_of(F.col("t"), EMAIL)).alias("email"),
        when(has_digit, spans_of(F.col("t"), IP)).alias("ip"),
        when(has_digit, spans_of(F.col("t"), CARD)).alias("runs"),
        when(F.col("t").contains("+"), spans_of(F.col("t"), PHONE)).alias("phone"),
        when(has_digit & F.col("t").rlike(r"[A-Z]{2}[0-9]{2}"), spans_of(F.col("t"), IBAN)).alias("iban"),
        when(has_digit & F.lower(F.col("t")).rlike(CONTEXT["phone"]) & F.col("t").rlike(NUMBER), spans_of(F.col("t"), NUMBER)).alias("numbers"),
    )
    text = F.col("t")
    bonus = lambda x, kind: F.when(near(text, x, kind), F.lit(0.3)).otherwise(F.lit(0.0))
    scored = lambda array, score: F.transform(array, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.least(score(x), F.lit(1.0)).alias("score")))
    base = {
        "email": scored("email", lambda x: F.lit(1.0)),
        "ip": scored(F.filter("ip", lambda x: x["s"].rlike(IS_IP)), lambda x: F.lit(1.0)),
        "card": scored(F.filter("runs", lambda x: n_digits(x).between(16, 19) & luhn(x["s"])), lambda x: F.lit(1.0)),
        "phone": scored(F.filter("phone", lambda x: n_digits(x).between(8, 15)), lambda x: F.lit(1.0)),
    }
    more = {
        "card": scored(F.filter("runs", lambda x: n_digits(x).between(12, 15)), lambda x: F.when(luhn(x["s"]), F.lit(0.4)).otherwise(F.lit(0.0)) + bonus(x, "card")),
        "phone": scored(F.filter("numbers", lambda x: n_digits(x).between(8, 15)), lambda x: F.lit(0.3) + bonus(x, "phone")),
        "iban": scored("iban", lambda x: F.when(mod97(x["s"]), F.lit(0.9)).otherwise(F.lit(0.2)) + bonus(x, "iban")),
    }
    d = d.select("doc_id", *[v.alias(f"base_{k}") for k, v in base.items()], *[F.filter(v, lambda x: x["score"] >= threshold).alias(f"more_{k}") for k, v in more.items()])
    for k in ("card", "iban", "phone"):  # an added span gives way to base spans and to added ones of the kinds before
        taken = F.concat(*[F.col(f"base_{b}") for b in base], *{"card": [], "iban": [F.col("more_card")], "phone": [F.col("more_card"), F.col("more_iban")]}[k])
        d = d.withColumn(f"more_{k}", F.filter(f"more_{k}", lambda x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))  # noqa: B023
    return d.select("doc_id", *[f"base_{k}" for k in base], *[f"more_{k}" for k in more])


def joined(kinds: dict[str, list[str]]) -> Column:
    """kind:start:end of all spans, by kind and then start."""
    def said(kind: str, cols: list[str]) -> Column:
        both = F.sort_array(F.concat(*[F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for c in cols]))
        return F.transform(both, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    parts = [said(kind, cols) for kind, cols in kinds.items()]
    return F.array_join(F.concat(*parts), ",")


def query(spark, sf_dir: str) -> DataFrame:
    base = ["email", "ip", "card", "phone"]
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    everything = {k: [c for c in (f"base_{k}", f"more_{k}") if c in found.columns] for k in KINDS}
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined({k: [f"base_{k}"] for k in base}), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
    )
