"""Operator 6: language identification by compression.

Each language has a zstandard raw-content dictionary, put together from a bounded sample of its labelled
texts. A text is compressed under each dictionary, in parts of a fixed size so that long texts lean on the dictionary
and not on themselves, and the language of the smallest sum is chosen; where the next one is hardly larger the
text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import records

UNDETERMINED = "und"
PARTS = 64


def fit(labelled: DataFrame, size: int = 65536, rows: int = 96, longest: int = 4096, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary of up to *size* bytes for each language.

    The sample is bounded: of each language *rows* rows, such as are no longer than *longest* characters first, then by
    a hash of the text, equal texts once; of a longer text *longest* characters go in. Rows without a language or text are passed over, keys aren't
    read, and an empty table gives no dictionary. Texts that share a hash and all else are one; else the order is total.
    """
    t = F.col(text)
    usable = labelled.filter(F.col(lang).isNotNull() & t.isNotNull() & (F.length(t) > 0))
    # only what the sample can hold of a text is shuffled
    short = usable.select(F.col(lang).alias("lang"), ((F.length(t) > longest) | (F.length(t) < 200)).alias("odd"), F.xxhash64(t).alias("h"), F.substring(t, 1, longest).alias("t"))
    # a language's first rows are among the first of each of its parts, so no task gets what all partitions offer of a language
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy("odd", "h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("odd", "h"))
    firsts = short.select("lang", "odd", "h", F.pmod("h", F.lit(PARTS)).alias("part")).distinct().withColumn("r", part).filter(F.col("r") <= rows)
    keys = firsts.select("lang", "odd", "h").withColumn("r", rank).filter(F.col("r") <= rows)
    sample = short.join(F.broadcast(keys), ["lang", "odd", "h"]).groupBy("lang", "r").agg(F.min("t").alias("t"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        texts.setdefault(r.lang, []).append((r.r, r.t))
    # what stands last in a dictionary is cheapest to refer to; the first rows go there
    return {k: "\n".join(t for _, t in sorted(v, reverse=True)).lower().encode("utf-8", "replace")[-size:] for k, v in sorted(texts.items())}


class Identifier:
    #: Short matches count: words of a language share syllables more than whole words.
    SEARCH = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 5, "min_match": 4, "target_length": 64}

    #: Texts of fewer bytes than SHORT, which zstandard would store as they are, follow a LEAD of known text.
    SHORT, LEAD = 256, 512

    def __init__(self, dictionaries: dict[str, bytes], part: int = 1024):
        import zstandard

        self.part = part
        self.coders = []
        search = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, **self.SEARCH)
        for lang, content in dictionaries.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=search)
            coder = zstandard.ZstdCompressor(compression_params=search, dict_data=held)
            lead = content[-self.LEAD :]
            self.coders.append((lang, coder, lead, len(coder.compress(lead))))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(bytes, language), smallest first; equal sizes in the order of the languages."""
        raw = text.lower().encode("utf-8", "replace")
        if len(raw) < self.SHORT:
            return sorted((max(1, len(c.compress(lead + raw)) - alone), lang) for lang, c, lead, alone in self.coders)
        parts = [raw[s : s + self.part] for s in range(0, len(raw), self.part)]
        return sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c, _, _ in self.coders)

    def identify(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1): the score grows with the next language's relative excess m, as m / (m + 0.02)."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        found = self.sizes(text)
        if len(found) == 1:
            return found[0][1], 1.0
        margin = (found[1][0] - found[0][0]) / found[0][0]
        return found[0][1], margin / (margin + 0.02)


def identified(docs: DataFrame, dictionaries: dict[str, bytes], least: float = 0.2, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "reliable")) -> DataFrame:
    """*docs* with the language, its score and whether that reaches *least* (narrower margins are rejected).

    Texts that are null, empty or without a letter get ``und``, 0 and false. Whole texts are compressed. The dictionaries
    are bounded by the number of languages; without any, all texts get ``und``. Of languages with equal sizes the first by name is
    chosen, with score 0. Repeated rows are judged each, alike; keys aren't read, so null ones matter nothing; an empty table
    stays empty. Columns of the same names are replaced.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Identifier(dictionaries)
        for texts in batches:
            yield records([known.identify(t.as_py()) for t in texts], lang_pred=pa.string(), score=pa.float64())

    both = docs.withColumn("__adjudica_found", found(F.col(text)))
    return both.withColumns({names[0]: F.col("__adjudica_found.lang_pred"), names[1]: F.col("__adjudica_found.score"), names[2]: F.col("__adjudica_found.score") >= least}).drop("__adjudica_found")
