"""Language identification by compression.

One zstandard raw-content dictionary per language holds pieces of labelled text. A text is
lower-cased and encoded with each dictionary; the language whose dictionary gives the fewest bytes wins. The
relative distance to the runner-up is the margin; `identify` rejects narrow margins.

Dictionaries are only compared at one length, as a longer one saves more bytes of any text. A
dictionary has DICTIONARY_BYTES, halved as often as its language's pieces need; the best of a length
goes on, cut, against those of the next shorter length. So a rare language costs the others nothing.
Languages with less than LEAST_BYTES of pieces aren't learned, unless no language has as much.

Defined results: null text, or text without a letter: `und`, score 0. Ties go to the smaller
language name at each length. Null or blank labels teach nothing. With no labelled row at all every text is `und`.
Repeated rows get one result each; extra columns of the input are left out. Very long texts count
whole, piece by piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

UNKNOWN = "und"
#: The sample that dictionaries are fitted on: about so many rows a language, one piece of so many characters each.
SAMPLE_ROWS, PIECE_CHARS, DICTIONARY_BYTES = 900, 200, 96 << 10
LEAST_BYTES = 3 << 10
#: Lower levels search the dictionary too little to tell close languages apart.
LEVEL = 6
#: Texts are encoded in pieces of so many bytes, or else a long text would be its own dictionary; all pieces count.
CHUNK_BYTES = 1500


def fit(train: DataFrame, rows: int = SAMPLE_ROWS, piece: int = PIECE_CHARS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of train(doc_id, lang, text).

    Bound: about `rows` rows for each language, chosen by a hash of doc_id, each giving a piece of
    at most `piece` characters from its middle; so what comes to the driver doesn't grow with the table.
    """
    known = train.filter("lang is not null and trim(lang) <> '' and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    space = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, math.ceil(space * min(1.0, rows / n)))])
    spot = F.xxhash64("doc_id", F.lit("sample"))
    start = F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - piece // 2)
    picked = known.filter(F.pmod(spot, F.lit(space)) < share[F.col("lang")]).select("lang", spot.alias("spot"), F.substr(F.col("text"), start, F.lit(piece)).alias("piece"))
    pieces: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        pieces.setdefault(r.lang, []).append((r.spot, r.piece))
    joined = {k: " ".join(p for _, p in sorted(v)).lower().encode() for k, v in pieces.items()}
    return fitted(joined, size)


def fitted(pieces: dict[str, bytes], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Each language's pieces cut to size, halved as often as needed, LEAST_BYTES at least."""
    usable = {k: v for k, v in sorted(pieces.items()) if len(v) >= LEAST_BYTES}
    if not usable:
        usable = {k: v for k, v in sorted(pieces.items()) if len(v) >= 8}
    out = {}
    for k, v in usable.items():
        n = size
        while n > len(v):
            n //= 2
        out[k] = v[:n]
    return out


def margin_score(best: int, second: int) -> float:
    """0.5 at a tie, towards 1 as the runner-up needs more bytes."""
    return 1 - 0.5 * math.exp(-20 * (second - best) / max(best, 1))


def _predict(dictionaries: dict[str, bytes], level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lengths = sorted({len(d) for d in dictionaries.values()}, reverse=True)
        made: dict[tuple[str, int], zstandard.ZstdCompressor] = {}

        def coder(lang: str, n: int) -> zstandard.ZstdCompressor:
            if (lang, n) not in made:
                d = zstandard.ZstdCompressionDict(dictionaries[lang][:n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made[lang, n] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
            return made[lang, n]

        def judged(chunks: list[bytes]) -> tuple[str, float, float]:
            """The language left at the last length, and its least score and margin on the way."""
            best, score, margin = None, 1.0, 1.0
            for n in lengths:
                langs = [k for k, d in dictionaries.items() if len(d) == n] + ([best] if best is not None else [])
                sizes = sorted((sum(len(coder(k, n).compress(x)) for x in chunks), k) for k in langs)
                if sizes[0][1] != best:
                    best, score, margin = sizes[0][1], 1.0, 1.0
                if len(sizes) > 1:
                    score = min(score, margin_score(sizes[0][0], sizes[1][0]))
                    margin = min(margin, (sizes[1][0] - sizes[0][0]) / max(sizes[0][0], 1))
            return best, score, margin

        for b in batches:
            langs, scores, margins = [], [], []
            for text in b.column("text").to_pylist():
                if not dictionaries or text is None or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                raw = text.lower().encode("utf-8", "replace")
                chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
                best, score, margin = judged(chunks)
                langs.append(best), scores.append(score), margins.append(margin)
            keep = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score", "margin"])

    return run


def classify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, id_col: str = "doc_id", flag: Column | None = None) -> DataFrame:
    """Best language, score and margin of every row of docs(id_col, text), whole texts."""
    common.bound_batches(docs.sparkSession)
    cols = [F.col(id_col)] + ([flag.alias("held_out")] if flag is not None else [])
    rows = docs.select(*cols, "text")
    schema = common.with_fields(rows.drop("text").schema, "lang_pred string, score double, margin double")
    return rows.mapInArrow(_predict(dictionaries, level), schema)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """As classify, but texts whose margin is under min_margin are rejected: `und`."""
    out = classify(docs, dictionaries)
    return out.withColumn("lang_pred", F.when(F.col("margin") >= min_margin, F.col("lang_pred")).otherwise(UNKNOWN))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~common.held_out("doc_id")))
    out = classify(docs, model, flag=common.held_out("doc_id"))
    return out.withColumn("rejected", F.col("margin") < 0.01)
