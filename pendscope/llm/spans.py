"""Positions of pattern matches, in code points, from SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,stop:bigint,word:string,inner:string>"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in column ``text``: array of (start, stop, word, inner),
    stop exclusive, inner being ``group``. The text between matches and the matches alternate, so a running sum of
    their lengths gives every position. Sums run over chunks of some square root of the matches each, from the sums of
    whole chunks before: an array that grows by one is copied, and so only short ones grow. Texts without a match cost
    one search."""
    regex = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    none = f"cast(array() as array<{SPAN}>)"
    pieces = f"arrays_zip(split(`{text}`, {regex}, -1), regexp_extract_all(`{text}`, {regex}, 0), regexp_extract_all(`{text}`, {regex}, {group}))"
    sizes = "transform(z, x -> bigint(length(x['0']) + coalesce(length(x['1']), 0)))"
    chunk = "slice({0}, c * w + 1, w)"
    bases = f"""aggregate(sequence(0, (size(z) - 1) div w), array(0L),
        (b, c) -> concat(b, array(b[c] + aggregate({chunk.format('n')}, 0L, (t, m) -> t + m))))"""
    placed = f"""aggregate({chunk.format('z')}, cast(named_struct('at', b[c], 'spans', array()) as struct<at:bigint,spans:array<{SPAN}>>),
      (done, x) -> if(x['1'] IS NULL, done, cast(named_struct(
        'at', done.at + length(x['0']) + length(x['1']),
        'spans', concat(done.spans, array(named_struct('start', done.at + length(x['0']), 'stop', done.at + length(x['0']) + length(x['1']),
          'word', x['1'], 'inner', x['2'])))) as struct<at:bigint,spans:array<{SPAN}>>)),
      done -> done.spans)"""
    # lambdas of one value name what is worked out once
    found = (f"transform(array({pieces}), z -> transform(array(int(ceil(sqrt(size(z))))), w -> transform(array({sizes}), n -> transform(array({bases}), "
             f"b -> flatten(transform(sequence(0, (size(z) - 1) div w), c -> {placed}))))[0])[0])[0][0]")
    return F.expr(f"if(regexp_like(`{text}`, {regex}), {found}, {none})")
