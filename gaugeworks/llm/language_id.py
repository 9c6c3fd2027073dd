"""Language ID by compression: the language whose dictionary compresses the text best.

Each language has a raw-content zstandard dictionary made from labelled texts. A text is compressed with each of
them and goes to the language with the smallest result; a narrow margin is a rejection. All texts, short or long,
are judged by the same compressors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Given where a text is null or has no letter.
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def spoken(text: str) -> bytes:
    """What is compressed: the words in lower case, a space between them; so shouting, tables and marks don't matter."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class Settings:
    """The bounds of the training sample, and the decision rule.

    A language's dictionary comes from at most `passages` passages of at most `passage_chars` characters, each from
    another labelled text; so all that is learned from is at most languages x passages x passage_chars characters.
    Texts that are judged are never cut.
    """

    passages: int = 256
    passage_chars: int = 800
    strata: int = 16
    level: int = 6
    #: A win by a smaller part of the runner-up's size than this is a rejection.
    min_margin: float = 0.01


def sample_passages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> dict[str, list[str]]:
    """A bounded sample of passages for each language, the same whatever the partitions.

    Rows with a null or letterless text or a null language are left out. Repeats of a text within a language count
    once: distinct hashes of texts are ranked within strata, so that no task gets all the rows of a language, and
    each task keeps only its best first. Only the passages of those chosen are read then.
    """
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranked = Window.partitionBy("lang", F.pmod("h", F.lit(settings.strata))).orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= max(1, settings.passages // settings.strata)).drop("n")
    begin = F.pmod(F.shiftright("h", 8), F.greatest(F.char_length("text") - settings.passage_chars, F.lit(0)) + 1)
    passage = F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(settings.passage_chars))
    best = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(passage).alias("passage"))  # both are bounded: see Settings
    found: dict[str, list[str]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["h"])):
        found.setdefault(row["lang"], []).append(row["passage"])
    return found


class Classifier:
    """A compressor for each language."""

    def __init__(self, passages: dict[str, list[str]], settings: Settings):
        import zstandard

        self._settings = settings
        self.languages = sorted(passages)
        self._compressors = []
        for lang in self.languages:
            content = b" ".join(spoken(p) for p in passages[lang]).ljust(8, b"\0")
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._compressors.append(zstandard.ZstdCompressor(level=settings.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes by language."""
        data = spoken(text)
        return [len(c.compress(data)) for c in self._compressors]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score (0 to 1), margin and whether it is rejected."""
        if not self.languages or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(text)
        ranked = sorted(zip(sizes, self.languages, strict=True))
        best, lang = ranked[0]
        margin = 1 - best / ranked[1][0] if len(ranked) > 1 else 1.0
        # a byte saved is 8 bits of evidence, tempered as neighbouring words aren't independent
        score = 1 / sum(math.exp(-min(700.0, (size - best) * 0.5)) for size, _ in ranked)
        return lang, score, margin, margin < self._settings.min_margin


RESULT_SCHEMA = "id long, lang_pred string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, passages: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), reject: bool = True) -> DataFrame:
    """A row per input row: id, lang_pred, score, margin, rejected.

    With `reject`, rejected rows get "und" as lang_pred; without it they keep the best language and the flag
    tells. A null text or one without a letter is "und", score 0, rejected. Ties go to the first language by
    name, and are rejected. Whole texts are compressed. No shuffle; the dictionaries are a bounded sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(passages, settings)
        for batch in batches:
            rows = [classifier.classify(text) for text in batch["text"]]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])
            if reject:
                out.loc[out["rejected"], "lang_pred"] = UNDETERMINED
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInPandas(run, RESULT_SCHEMA)
