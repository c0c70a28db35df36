"""The two functions that need Python: shell words, and cutting nested JSON. Arrow batches, a few lines each."""

from __future__ import annotations

import json
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MAX_ITEMS = 20
MAX_CHARS = 200
SEPARATORS = {";", "&&", "||", "|", "&", "("}


def command_words(line: str) -> list[str]:
    """The programs at command position; assignments before them are skipped. What is no shell command gives none."""
    lexer = shlex.shlex(line, posix=True, punctuation_chars=True)
    lexer.whitespace_split, lexer.commenters = True, ""
    found, expect = [], True
    try:
        for word in lexer:
            if word in SEPARATORS:
                expect = True
            elif expect and not ("=" in word and word.split("=")[0].isidentifier()):
                found.append(word.rsplit("/", 1)[-1])
                expect = False
    except ValueError:
        return []
    return found


@F.pandas_udf(ArrayType(StringType()))
def commands(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [w for line in (t or "").split("\n") for w in command_words(line)])


#: The marks that stand for what was left out.
ITEMS_MARK, CHARS_MARK = "…+{} more", "…(+{} chars)"


def cut(value, items: int = MAX_ITEMS, chars: int = MAX_CHARS):
    """Long lists and strings of parsed JSON cut in place, from a list of the places still to be looked at, however deep."""
    box = [value]
    places = [(box, 0)]
    for holder, at in places:
        here = holder[at]
        match here:
            case str() if len(here) > chars:
                holder[at] = here[:chars] + CHARS_MARK.format(len(here) - chars)
            case dict():
                places += [(here, name) for name in here]
            case list():
                places += [(here, k) for k in range(min(items, len(here)))]
                if len(here) > items:
                    here[items:] = [ITEMS_MARK.format(len(here) - items)]
    return box[0]


@F.pandas_udf(StringType())
def shrink_json(text: pd.Series) -> pd.Series:
    """JSON with long lists and strings cut; anything else with its white space folded; null stays null."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(cut(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return " ".join(t.split())

    return text.map(one)
