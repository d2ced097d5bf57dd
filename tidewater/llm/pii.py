"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base formats, every window of up to
GROUPS neighbouring groups of digits with 7 to 19 digits in all, and addresses written with "at" and
"dot". Base spans that are valid (parts of an ip, check digit of a card, digits of a phone) always
stand, and the others are looked for in what is left beside them. Those are scored by
gradient-boosted trees on their format and context; of the ones at or above the threshold of their
kind, the leftmost are added, of one start the best scored, none overlapping another.

The trees are grown on the driver and become one expression; texts never leave the JVM. They are
fitted on candidates that the same generators find: in labelled sentences (`sentences`), and in a
bounded sample of documents, where valid base spans tell which windows are right. Thresholds give a
precision of 0.95 on distinct rows that no tree was grown on.

Every pattern is of the form gap, match, anchored at the end of the match before, with possessive
loops, and positions, texts between spans and choices are made in pieces of CHUNK: all takes time
proportional to the text and no stack, however long a run is and however many spans there are.

Defined results: null is the empty text and has no spans. Repeated rows get one result each. Ties of
score go to the longer span. Very long texts are searched whole. An empty table gives no rows. Extra
columns are left out by `detect`, kept by `redact`, whatever their names; null texts stay null there.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Text before a match, and the match, of each base kind.
BASE = {
    "email": (rf"(?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!@{_DOMAIN}++\.{_DOMAIN}))*+", rf"{_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"),
    "ip": (r"(?:[^0-9]++|[0-9]++(?!(?:\.[0-9]++){3}))*+", r"[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"(?:[^0-9]++|[0-9](?![\x20-]?[0-9]))*+", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"(?:[^+]++|\+(?![0-9][\x20().0-9-]+[0-9]))*+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_AT, _DOT = r"\x20?[\[(](?:at|AT)[\])]\x20?", r"\x20?[\[(](?:dot|DOT)[\])]\x20?"
#: Groups of digits, and spelled addresses; the last match is the empty one at the end.
DIGITS = (r"[^0-9]*+", r"[0-9]++|\z")
SPELLED = (rf"(?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!{_AT}{_DOMAIN}))*+", rf"{_LOCAL}++{_AT}{_DOMAIN}++(?:(?:\.|{_DOT}){_DOMAIN}++)*+|\z")
#: Words before a number that tell its kind.
_WORDS = {
    "phone": "tel|telephone|telefon|téléphone|teléfono|phones?|call|ring|fax|mobile|cell|whatsapp",
    "card": "cards?|credit|debit|visa|mastercard|amex|cc",
    "id": "ssn|social security|social|passport|iban|account|acct|license|licence",
    "other": "order|invoice|isbn|issn|ref|reference|serial|version|page|pages|part|total|sku|tracking|population|line|lines|id|item|build|lot|batch|year|since|in|of|on|number",
}
CHUNK, CONTEXT, GROUPS = 256, 48, 8
#: What stands in the place of a base span while the rest is searched.
_BLANK = "\u0001"
#: Documents, and candidates of them, that the trees are fitted on at most.
SAMPLE_ROWS, SAMPLE_CANDIDATES = 20_000, 4000

_FOUND = "array<struct<start:int,end:int,value:string>>"
_TOKENS = "array<struct<start:int,end:int,value:string,left:string,right:string,sep:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def chunks(of: Column) -> Column:
    """The array in pieces, so that running totals don't copy a long array once an element."""
    last = F.floor((F.size(of) - 1) / CHUNK).cast("int")
    return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(of, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(of), 1, 0))


def placed(docs: DataFrame, raw: dict[str, Column], ddl: str) -> DataFrame:
    """docs with arrays of the type ddl, made from arrays of g and m, the lengths of gap and match, and the further fields.

    Each step is a projection of its own, so that no array is made twice.
    """
    fields = [f.split(":")[0] for f in ddl[ddl.rindex("<") + 1 : ddl.index(">")].split(",")][2:]

    def totals(of: Column) -> Column:
        sums = F.transform(of, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + x.g + x.m))
        return F.slice(F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(1), F.size(of))

    def inner(ch: Column, offset: Column) -> Column:
        empty = F.struct(offset.alias("at"), F.array().cast(ddl).alias("out"))
        one = lambda a, x: F.struct((a.at + x.g).alias("start"), (a.at + x.g + x.m).alias("end"), *(x[f].alias(f) for f in fields))
        return F.aggregate(ch, empty, lambda a, x: F.struct((a.at + x.g + x.m).alias("at"), F.concat(a.out, F.array(one(a, x))).alias("out")), lambda a: a.out)

    out = docs.withColumns({f"pairs_{k}": v for k, v in raw.items()})
    out = out.withColumns({f"chunks_{k}": chunks(F.col(f"pairs_{k}")) for k in raw}).drop(*(f"pairs_{k}" for k in raw))
    return out.withColumns({k: F.flatten(F.zip_with(F.col(f"chunks_{k}"), totals(F.col(f"chunks_{k}")), inner)) for k in raw}).drop(*(f"chunks_{k}" for k in raw))


def matches(text: Column, gap: str, match: str, needed: Column, make: Callable[[Column, Column], list[Column]], ddl: str) -> Column:
    """The leftmost matches that don't overlap, as structs of g, m and what make gives; of texts that meet the condition only."""
    pattern = F.lit(rf"(?s)\G({gap})({match})")
    found = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), *make(g, m)))
    return F.when(needed, found).otherwise(F.array().cast(ddl.replace("start:", "g:").replace("end:", "m:")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 14 to 19 digits have a valid check digit."""
    d = F.reverse(digits(value))
    n = F.length(d)
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _span(kind: str, c: Column) -> Column:
    return F.struct(c.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), c.end.alias("end"))


def _valid_spans(kind: str, candidates: Column) -> Column:
    return F.transform(F.filter(candidates, lambda c: valid(kind, c.value)), lambda c: _span(kind, c))


def replaced(docs: DataFrame, text: str, spans: str, put: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """docs with a column `name`: the text with put(span, where the text before it ends) in the place of each span."""
    out = docs.withColumn("rp_chunks", chunks(F.col(spans)))
    ends = F.transform("rp_chunks", lambda ch: F.array_max(F.transform(ch, lambda x: x.end)))
    out = out.withColumn("rp_from", F.aggregate(ends, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x)))))
    low, high = (lambda i: F.get(F.col("rp_from"), i)), (lambda i: F.get(F.col("rp_from"), i + 1))
    cut = F.transform("rp_chunks", lambda ch, i: F.struct(ch.alias("ch"), low(i).alias("low"), F.substr(F.col(text), low(i) + 1, high(i) - low(i)).alias("t")))

    def parts(c: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            piece = F.concat(F.substr(c.t, a.at - c.low + 1, F.greatest(x.start - a.at, F.lit(0))), put(x, a.at))
            return F.struct(F.greatest(a.at, x.end).alias("at"), F.concat(a.out, F.array(piece)).alias("out"))

        return F.aggregate(c.ch, F.struct(c.low.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: a.out)

    whole = F.concat(F.array_join(F.flatten(F.transform(cut, parts)), ""), F.substr(F.col(text), F.element_at("rp_from", -1) + 1, F.length(text)))
    return out.withColumn(name, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop("rp_chunks", "rp_from")


def leftmost(spans: Column, ddl: str) -> Column:
    """Of spans in order, those that begin at or after the end of the last one taken."""

    def inner(a: Column, ch: Column) -> Column:
        take = lambda b, x: F.when(x.start >= b.at, F.struct(x.end.alias("at"), F.concat(b.out, F.array(x)).alias("out"))).otherwise(b)
        return F.aggregate(ch, F.struct(a.at.alias("at"), F.array().cast(ddl).alias("out")), take, lambda b: F.struct(b.at.alias("at"), F.concat(a.out, F.array(b.out)).alias("out")))

    return F.aggregate(chunks(spans), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ddl}>").alias("out")), inner, lambda a: F.flatten(a.out))


# Candidates --------------------------------------------------------------------------------------

FEATURES = (
    "digits", "other", "groups", "luhn", "phone_word", "card_word", "id_word", "other_word", "phone_shape", "id_shape", "card_shape", "date_shape", "plus", "glued", "listed", "runs_in", "runs_on", "spelled", "dotted",
)


def features(c: Column, spelled: bool) -> list[Column]:
    """Numbers for each of FEATURES of a candidate struct with value, groups, before and after."""
    word = lambda k: c.before.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{_WORDS[k]})\b[^\p{{L}}\p{{N}}]{{0,4}}(?:(?:no|number|is|nr|me|at|on|us)\b[^\p{{L}}\p{{N}}]{{0,3}}){{0,2}}$")
    n = F.length(digits(c.value))
    one = lambda x: x.cast("int")
    return [
        n,
        F.length(c.value) - n,
        c.groups,
        one(luhn(c.value)),
        one(word("phone")),
        one(word("card")),
        one(word("id")),
        one(word("other")),
        one(c.value.rlike(r"^(?:[0-9]{1,3}[\x20.-]\(?|[0-9]{1,3}\x20\()?(?:[0-9]{3}\)?[\x20.-]?\x20?)?[0-9]{3}[\x20.-][0-9]{4}$|^0[0-9]{1,4}(?:[\x20-][0-9]{2,7}){1,4}$")),
        one(c.value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        one(c.value.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$|^[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$|^[0-9]{13,19}$")),
        one(c.value.rlike(r"^(?:19|20)[0-9]{2}[.-]?(?:0[1-9]|1[0-2])[.-]?(?:[0-2][0-9]|3[01])(?:\x20[0-9]{1,2})?$|^(?:[0-2]?[0-9]|3[01])[.-](?:0?[1-9]|1[0-2])[.-](?:19|20)[0-9]{2}|^(?:1[0-9]|20)[0-9]{2}[\x20-]{1,2}(?:1[0-9]|20)[0-9]{2}$")),
        one(c.before.rlike(r"\+$")),
        one(c.before.rlike(r"[\p{L}\p{N}_]$") | c.after.rlike(r"^[\p{L}\p{N}_]")),
        one(c.before.rlike(r"[0-9]{3,4}[\x20.-][0-9]{4}[\x20,;/]{1,3}(?:(?:or|and|oder|ou|o)\x20)?\(?$")),
        one(c.runs_in),
        one(c.runs_on),
        F.lit(int(spelled)),
        one(c.value.rlike(rf"(?:\.|{_DOT})[A-Za-z]{{2,}}$")),
    ]


def windows(t: Column) -> Column:
    """Candidates of an array of digit groups in order: start, end, value, groups, before, after, whether digits go on before and after."""
    here = lambda i: F.get(t, i)

    def eligible(i: Column) -> Column:
        step = lambda a, x: F.struct((a.on & x.sep.isNotNull() & (x.value != "")).alias("on"), (a.n + F.when(a.on & x.sep.isNotNull(), F.length(x.value)).otherwise(0)).alias("n"))
        return F.length(here(i).value).between(1, 19) & F.aggregate(F.slice(t, i + 2, F.lit(GROUPS - 1)), F.struct(F.lit(True).alias("on"), F.length(here(i).value).alias("n")), step, lambda a: a.n >= 7)

    def of(i: Column) -> Column:
        before = F.array_join(F.transform(F.slice(t, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))), lambda x: F.concat(x.right, F.right(x.value, F.lit(CONTEXT)))), "")
        cut = F.transform(F.sequence(F.lit(1), F.lit(GROUPS)), lambda k: F.struct(k.alias("k"), F.slice(t, i + 1, k).alias("s"), F.slice(t, i + 2, k - 1).alias("more")))
        total = lambda w: F.aggregate(w.s, F.lit(0), lambda a, x: a + F.length(x.value))
        good = F.filter(cut, lambda w: (F.size(w.s) == w.k) & F.forall(w.more, lambda x: x.sep.isNotNull() & (x.value != "")) & total(w).between(7, 19))
        value = lambda w: F.concat(here(i).value, F.array_join(F.transform(w.more, lambda x: F.concat(x.sep, x.value)), ""))
        return F.transform(good, lambda w: F.struct(here(i).start.alias("start"), F.element_at(w.s, -1).end.alias("end"), value(w).alias("value"), w.k.alias("groups"), F.right(F.concat(before, here(i).right), F.lit(CONTEXT)).alias("before"), F.coalesce(here(i + w.k).left, F.lit("")).alias("after"), here(i).sep.isNotNull().alias("runs_in"), F.coalesce(here(i + w.k).sep.isNotNull() & (here(i + w.k).value != ""), F.lit(False)).alias("runs_on")))

    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), eligible)
    return F.when(F.size(t) > 0, F.flatten(F.transform(starts, of))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,groups:int,before:string,after:string,runs_in:boolean,runs_on:boolean>>"))


def spelled_out(t: Column) -> Column:
    """As windows, of spelled addresses."""
    after = lambda i: F.coalesce(F.get(t, i + 1).left, F.lit(""))
    one = lambda x, i: F.struct(x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), F.lit(1).alias("groups"), x.right.alias("before"), after(i).alias("after"), F.lit(False).alias("runs_in"), F.lit(False).alias("runs_on"))
    return F.filter(F.transform(t, one), lambda c: c.value != "")


def based(docs: DataFrame) -> DataFrame:
    """docs(text) with pii_text, never null, and pii_base: the valid base spans in order."""
    out = docs.withColumn("pii_text", F.coalesce("text", F.lit("")))
    text = F.col("pii_text")
    # the same as matching everywhere, but cheaper
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    out = placed(out, {f"pii_{k}": matches(text, *p, needs.get(k, text.rlike("[0-9]")), lambda g, m: [m.alias("value")], _FOUND) for k, p in BASE.items()}, _FOUND)
    return out.withColumn("pii_base", F.array_sort(F.concat(*(_valid_spans(k, F.col(f"pii_{k}")) for k in BASE)))).drop(*(f"pii_{k}" for k in BASE))


def told(docs: DataFrame, text: str) -> DataFrame:
    """docs with told_number and told_spelled: start, end and features of each candidate of a text column."""
    t = F.col(text)

    def make(g: Column, m: Column) -> list[Column]:
        return [m.alias("value"), F.substr(g, F.lit(1), F.lit(2)).alias("left"), F.right(g, F.lit(CONTEXT)).alias("right"), F.when(g.rlike(r"^[\x20().-]{1,2}$"), g).alias("sep")]

    needs = {"number": t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), "spelled": t.rlike(r"[\[(](?:at|AT)[\])]")}
    out = placed(docs, {f"told_{k}": matches(t, *p, needs[k], make, _TOKENS) for k, p in (("number", DIGITS), ("spelled", SPELLED))}, _TOKENS)
    out = out.withColumns({"told_number": windows(F.col("told_number")), "told_spelled": spelled_out(F.col("told_spelled"))})
    with_features = lambda k: F.transform(f"told_{k}", lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), F.array(*(x.cast("double") for x in features(c, k == "spelled"))).alias("f")))
    return out.withColumns({f"told_{k}": with_features(k) for k in needs})


# The model ---------------------------------------------------------------------------------------


def kind_of(f) -> Column:
    """The rank of the kind that a candidate would be, by its features."""
    at = {k: f[i] for i, k in enumerate(FEATURES)}
    card = (at["card_word"] == 1) | ((at["luhn"] == 1) & (at["id_word"] == 0))
    return F.when(at["spelled"] == 1, KINDS.index("email")).when(card, KINDS.index("card")).when((at["id_word"] == 1) | (at["id_shape"] == 1), KINDS.index("id")).otherwise(KINDS.index("phone"))


def sentences(seed: int = 3) -> list[tuple[str, list[str]]]:
    """The labelled sentences: texts, and the strings in them that are personal data. Numbers are invented.

    Formats and words vary apart from each other, so that trees can't learn one by heart from the other.
    """
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    phones = (lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)} {d(6)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: "5" + d(9), lambda: f"1-800-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"0{d(3)}-{d(7)}")
    cards = (lambda: f"4{d(3)} {d(4)} {d(4)} {d(4)}", lambda: f"5{d(3)}-{d(4)}-{d(4)}-{d(4)}", lambda: "4" + d(12), lambda: "37" + d(13), lambda: f"37{d(2)} {d(6)} {d(5)}")
    ids = (lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: d(9), lambda: d(8), lambda: d(12), lambda: f"{d(4)} {d(4)}")
    names = ("joe", "a.smith", "mary_k", "info2", "x-y", "j", "the.long.name.of.a.person", "u4711", "sales", "no-reply")
    hosts = (lambda: f"{r.choice(('example', 'mail-7', 'post', 'x', 'university-of-somewhere', 'net24'))}{r.choice((' [dot] ', '[dot]', '.', '(dot)'))}{r.choice(('com', 'org', 'net'))}",)
    plain = (lambda: d(16), lambda: d(14), lambda: d(17), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: d(7), lambda: d(8), lambda: d(10), lambda: d(12), lambda: d(15), lambda: f"{d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(2)}.{d(3)}.{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", lambda: f"20{d(2)}0{r.randint(1, 9)}1{d(1)}", lambda: f"1{r.randint(0, 9)}.0{r.randint(1, 9)}.20{d(2)}", lambda: f"19{d(2)}-20{d(2)}", lambda: f"19{d(2)} 20{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(1)}.{d(2)}.{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}")
    out: list[tuple[str, list[str]]] = []
    for before, after in (("tel: ", ""), ("Tel. ", " today"), ("call ", " now"), ("please call me at ", ", thanks"), ("phone ", "."), ("Phone number: ", ""), ("Phone no. ", "\n"), ("fax: ", ""), ("mobile ", " only"), ("my cell is ", "."), ("whatsapp ", " x"), ("Telefon: ", ""), ("téléphone ", " merci"), ("teléfono ", ""), ("ring ", " first")):
        for _ in range(12):
            a, b = r.choice(phones)(), r.choice(phones)()
            out.append((f"{before}{a}{after}", [a]))
            if r.random() < 0.7 and len(a) > 9 and a[-5] in "-. ":
                out.append((f"{before}{a}{r.choice((' or ', ', ', ' / ', ' '))}{b}{after}", [a, b]))
    for before, after in (("card ", ""), ("card number: ", " exp 01/30"), ("my credit card is ", "."), ("visa ", ""), ("Mastercard ", " ok"), ("amex ", ""), ("debit ", " please"), ("cc ", "")):
        out += [(f"{before}{c}{after}", [c]) for _ in range(12) for c in [r.choice(cards)()]]


    for before in ("", "x ", "at ", "und ", "now "):
        for _ in range(8):
            a = r.choice((f"1 ({d(3)}) {d(3)}-{d(4)}", f"4{d(1)} {d(3)} {d(4)} {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)}"))
            out.append((f"{before}+{a} {_BLANK * r.randint(7, 15)}", [a]))  # beside a base span

    def checked(digits: str) -> str:
        """digits and the check digit that makes them a card's."""
        total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, digits[::-1])))
        return f"{digits}{-total % 10}"

    grouped = lambda c: r.choice((c, c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"))
    for before, between, after in (("", " ", ""), ("was ", " ", " and"), ("x ", "  ", " y"), ("paid by ", " ", "."), ("+", " ", "")):
        for _ in range(16):
            a, b, c = grouped(checked(d(15))), grouped(checked(d(15))), str(int("1" + d(14)) // 10 * 10 + 1)
            c += str((int(checked(c)[-1]) + r.randint(1, 9)) % 10)  # a number whose check digit is wrong
            x, y = r.choice(((a, b), (a, c), (c, a)))
            out.append((f"{before}{x}{between}{y}{after}", [z for z in (x, y) if z is not c]))
    for before, after in (("SSN ", ""), ("my SSN is ", "."), ("social security number ", ""), ("passport ", " valid"), ("Passport no. ", ""), ("account ", ""), ("account number: ", "\n"), ("acct ", ""), ("license ", ".")):
        out += [(f"{before}{c}{after}", [c]) for _ in range(12) for c in [r.choice(ids)()]]
    out += [(f"{a}{c}{b}", [c]) for a, b in (("write to ", ""), ("contact ", " please"), ("", " is me"), ("mail: ", ".")) for _ in range(12) for c in [f"{r.choice(names)}{r.choice((' [at] ', '(at)', '[at]', ' (AT) '))}{r.choice(hosts)()}"]]
    out += [(f"{a} {r.choice(('[at]', '(at)'))} {b}", []) for a in ("meet", "look", "we were", "arrive", "smile", "be there", "x", "good", "bad2") for b in ("noon", "five", "the door", "home 2", "8", "2024 or so", "work.", "s")]
    for before, after in (("order ", ""), ("invoice no. ", " due"), ("ISBN ", ""), ("ref ", " in"), ("serial ", ""), ("version ", " is out"), ("on ", " we"), ("population ", ""), ("$", " paid"), ("total ", "."), ("page ", ""), ("the number ", " of the year"), ("since ", ""), ("tracking ", ""), ("and ", " and"), ("it was ", " that"), ("x = ", ";"), ("sum of ", " is"), ("batch ", ""), ("", " words"), ("v", ""), ("a", "b"), ("id_", "")):
        out += [(f"{before}{c}{after}", []) for _ in range(16) for c in [r.choice(plain)()]]
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree of Newton steps as (feature, threshold, left, right) or a leaf value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0:
        return leaf
    best, base = None, g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= t
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - base
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, float(t), left)
    if best is None:
        return leaf
    _, j, t, left = best
    return (j, t, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        j, t, left, right = tree
        tree = left if row[j] <= t else right
    return tree


def _labelled(spark: SparkSession) -> list[tuple[tuple[float, ...], int]]:
    """Features and label of every candidate in the labelled sentences.

    Windows over parts of two numbers whose check digit is right by chance are left out: what is left of them is taken first.
    """
    marked = []
    for text, right in sentences():
        at, spans = 0, []
        for x in right:
            at = text.index(x, at)
            spans.append((at + x.startswith("("), at + len(x)))  # windows begin with a digit
            at += len(x)
        marked.append((text, spans))
    written = json.dumps([{"i": i, "text": t} for i, (t, _) in enumerate(marked)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(written), "array<struct<i:int,text:string>>")))
    found = told(rows, "text").select("i", F.explode(F.concat("told_number", "told_spelled")).alias("c")).select("i", "c.*")
    out, checked = [], FEATURES.index("luhn")
    for r in found.collect():
        right = (r.start, r.end) in marked[r.i][1]
        if right or not r.f[checked] or not any(a < r.end and r.start < b for a, b in marked[r.i][1]):
            out.append((tuple(r.f), int(right)))
    return out


def _sampled(docs: DataFrame, rows: int, candidates: int) -> list[tuple[tuple[float, ...], int]]:
    """Features of candidates in a sample of documents; right are those that are valid base spans, or such a phone without its plus sign.

    Numbers whose check digit is right though no base span has them are left out: nothing tells what they are.
    """
    n = docs.count()
    space = 1 << 30
    spot = F.xxhash64("text", F.lit("pii"))
    some = docs.select("text").filter(F.pmod(spot, F.lit(space)) < int(min(1.0, rows / max(n, 1)) * space)).distinct()
    found = told(based(some), "pii_text")
    plus = lambda s: (s.rank == KINDS.index("phone")).cast("int")
    right = F.transform("told_number", lambda c: F.struct(c.f.alias("f"), F.exists("pii_base", lambda s: (s.end == c.end) & (s.start + plus(s) == c.start) & s.rank.isin(KINDS.index("phone"), KINDS.index("card"))).cast("int").alias("y")))
    taken = found.select(F.xxhash64("pii_text").alias("h"), F.posexplode(F.filter(right, lambda c: (c.y == 1) | (c.f[FEATURES.index("luhn")] == 0))).alias("at", "c")).orderBy(F.xxhash64("h", "at"), "h", "at").limit(candidates)
    return [(tuple(r.c.f), r.c.y) for r in taken.collect()]


class Model:
    """First score, trees, and the threshold of each kind."""

    def __init__(self, first: float, trees: list, limits: dict[str, float]):
        self.first, self.trees, self.limits = first, trees, limits

    def score(self, f: str) -> str:
        """SQL for the score of a candidate whose features are the array f."""
        return f"1 / (1 + exp(-({self.first!r}D{''.join(f' + {rate!r}D * {_sql(t, f)}' for rate, t in self.trees)})))"


def grown(rows: list[tuple[tuple[float, ...], int]], rounds: int = 14, depth: int = 5, rate: float = 0.5) -> Model:
    """Trees on two thirds of the distinct rows, thresholds by the rest, each distinct row counted once: halfway below the least score with a precision of 0.95 or more."""
    seen: dict[tuple[float, ...], list[int]] = {}
    for f, label in rows:
        seen.setdefault(f, [0, 0])[label] += 1
    keys = sorted(seen)
    x, n = np.array(keys, dtype=float).reshape(-1, len(FEATURES)), np.array([seen[k] for k in keys], dtype=float).reshape(-1, 2)
    y, w = n[:, 1] / n.sum(1), np.sqrt(n.sum(1))
    apart = np.array([zlib.crc32(np.array(k).tobytes()) % 3 == 1 for k in keys])
    p = (w * y)[~apart].sum() / w[~apart].sum()
    z = np.full(len(y), np.log(p / (1 - p)))
    first, trees = float(z[0]), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x[~apart], (w * (p - y))[~apart], (w * p * (1 - p))[~apart], depth)
        trees.append((rate, tree))
        z += rate * np.array([_value(tree, r) for r in x])
    p, limits, at = 1 / (1 + np.exp(-z)), {}, {k: i for i, k in enumerate(FEATURES)}
    is_card = (x[:, at["card_word"]] == 1) | ((x[:, at["luhn"]] == 1) & (x[:, at["id_word"]] == 0))
    is_id = ((x[:, at["id_word"]] == 1) | (x[:, at["id_shape"]] == 1)) & ~is_card
    email = x[:, at["spelled"]] == 1
    for kind, of in (("email", email), ("card", is_card & ~email), ("id", is_id & ~email), ("phone", ~is_card & ~is_id & ~email)):
        mine = apart & of
        values = np.concatenate([[0.0], np.unique(p[mine])])
        good = [i for i in range(1, len(values)) if y[mine & (p >= values[i])].mean() >= 0.95]
        limits[kind] = float(max(0.5, values[good[0] - 1 : good[0] + 1].mean())) if good else 1.0
    return Model(first, trees, limits)


_GROWN: dict[str, Model] = {}


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, candidates: int = SAMPLE_CANDIDATES) -> Model:
    """A model from the labelled sentences and a sample of docs: about `rows` documents, at most `candidates` candidates."""
    return grown(_labelled(docs.sparkSession) + _sampled(docs, rows, candidates))


def general(spark: SparkSession) -> Model:
    """The model of the labelled sentences alone."""
    if "" not in _GROWN:
        _GROWN[""] = grown(_labelled(spark))
    return _GROWN[""]


def _sql(tree, f: str) -> str:
    if not isinstance(tree, tuple):
        return f"({float(tree)!r}D)"
    j, t, left, right = tree
    return f"(CASE WHEN {f}[{j}] <= {t!r}D THEN {_sql(left, f)} ELSE {_sql(right, f)} END)"


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.rank), s.start, s.end)), ",")


def found(docs: DataFrame, model: Model) -> DataFrame:
    """docs with pii_base and pii_spans: arrays of start, rank of kind, end of its text."""
    out = replaced(based(docs), "pii_text", "pii_base", lambda s, at: F.repeat(F.lit(_BLANK), F.greatest(s.end - F.greatest(s.start, at), F.lit(0))), "pii_rest")
    out = told(out, "pii_rest").withColumn("told", F.concat("told_number", "told_spelled")).drop("told_number", "told_spelled", "pii_rest")
    out = out.withColumn("told", F.transform("told", lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), kind_of(c.f).alias("rank"), c.f.alias("f"))))
    scored = F.expr(f"transform(told, c -> named_struct('start', c.start, 'end', c.end, 'rank', c.rank, 'p', {model.score('c.f')}))")
    limits = F.array(*(F.lit(model.limits.get(k, 1.0)) for k in KINDS))
    out = out.withColumn("told", F.when(F.size("told") > 0, F.filter(scored, lambda c: c.p >= F.get(limits, c.rank))).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,p:double>>")))
    ordered = F.transform(F.array_sort(F.transform("told", lambda c: F.struct(c.start.alias("start"), (-F.round(c.p, 6)).alias("p"), (-c.end).alias("back"), c.rank.alias("rank")))), lambda c: F.struct(c.start.alias("start"), c.rank.alias("rank"), (-c.back).alias("end")))
    out = out.withColumn("told", ordered)
    return out.withColumn("pii_spans", F.array_sort(F.concat("pii_base", leftmost(F.col("told"), _SPANS)))).drop("told", "pii_text")


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    rows = found(docs.select("doc_id", "text"), model or general(docs.sparkSession))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s.rank == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in BASE), F.sha2(written_spans(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), written_spans(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each span of its text replaced by the kind in angle brackets; overlapping spans by that of the first."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    rows = found(common.packed(docs).withColumnRenamed("text_", "text"), model or general(docs.sparkSession))
    out = replaced(rows, "text", "pii_spans", lambda s, at: F.when(s.start >= at, F.get(names, s.rank)).otherwise(""), "out_")
    return out.select(*(F.col("out_").alias("text") if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced, n_chars counted anew. The model is fitted on the table documents."""
    out = redact(docs, fit(common.table(spark, sf_dir, "documents")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
