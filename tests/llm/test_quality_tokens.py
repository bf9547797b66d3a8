"""Tokens of the quality grams: white space and punctuation by named characters."""

import re

from pyspark.sql import functions as F

from freshlane.llm import quality
from freshlane.llm.common import words


def test_tokens_of_the_quality_grams(spark):
    """Runs of punctuation, and of anything else but white space, by every character below U+0100 and some above."""
    texts = ["".join(chr(c) + d for c in range(1, 256)) for d in ("", "a", " ", "._", "\\")] + ["ä—b c\U0001F600!?d", "$0 $1 \\1"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.col("text"), words(F.regexp_replace("text", quality.PUNCTUATION_RUN, " $0 ")).alias("w")).collect()
    for r in rows:
        assert r.w == re.findall(r"[!-/:-@\[-`{-~]+|[^ \t-\r!-/:-@\[-`{-~]+", r.text)
