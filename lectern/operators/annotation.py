"""Depths and states of the tokens of texts of any length.

A long text is cut into pieces at places that no token crosses: after a line end, or before a run of blanks. Each piece's
effect on the annotator's state is summed up on its own; the effects of a text's pieces are followed in order (a few
hundred bytes a piece), and then each piece is annotated on its own from the state that it's entered in.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.annotate import START, annotate_lists, effects_of
from lectern.functions.tokens import tokenise
from lectern.session import materialise, ship, spread

#: Characters of a piece, about.
PIECE = 1 << 16


def pieces(text: Column, chars: int = PIECE) -> Column:
    """A text as pieces of at most about `chars` characters that tokenise one by one as the whole does; a stretch without line ends or blanks stays whole."""
    blank = r"[ \f\x0B]"
    end = rf"(?:(?<=\n)|(?<!{blank})(?={blank})|\z)"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{chars}}}{end}|.+?{end}"), F.lit(0))


def annotate_texts(rows: DataFrame, key: str, text: str = "text", chars: int = PIECE) -> DataFrame:
    """key, piece (from 0), tokens, depth, state: a row for each piece of each text.

    Keys may be null or repeat: rows are numbered first. A null or empty text gives no rows.
    """
    ship(rows.sparkSession)
    # a few small files are dealt to all cores: each step below works on the pieces as they are written here
    numbered = spread(rows.select(*dict.fromkeys((key, text)))).select(F.col(key).alias("key"), pieces(F.col(text), chars).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    cut = materialise(numbered.select("key", "row", F.size("parts").alias("of"), F.posexplode("parts").alias("piece", "part")), "pieces")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("piece"), pa.array([pickle.dumps(e) for e in effects_of(batch.column("tokens"))], pa.binary())], names=["row", "piece", "effect"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, START
        for batch in batches:
            out = []
            for row, effect in zip(batch.column("row").to_pylist(), batch.column("effect").to_pylist(), strict=True):
                if row != at:
                    at, state = row, START
                out.append(pickle.dumps(state))
                state = pickle.loads(effect).on(state)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("piece"), pa.array(out, pa.binary())], names=["row", "piece", "entry"])

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = [START if e is None else pickle.loads(e) for e in batch.column("entry").to_pylist()]
            depth, state = annotate_lists(batch.column("tokens"), entry)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "tokens")), depth, state], names=[key, "piece", "tokens", "depth", "state"])

    long = cut.filter("of > 1").select("row", "piece", tokenise(F.col("part")).alias("tokens"))
    effects = long.mapInArrow(sum_up, "row long, piece int, effect binary").repartition("row").sortWithinPartitions("row", "piece")
    entries = materialise(effects.mapInArrow(follow, "row long, piece int, entry binary"), "entries")
    whole = cut.join(entries, ["row", "piece"], "left").select("key", "piece", tokenise(F.col("part")).alias("tokens"), "entry")
    kind = rows.schema[key].dataType.simpleString()
    return whole.mapInArrow(annotate, f"`{key}` {kind}, piece int, tokens array<string>, depth array<int>, state array<int>")
