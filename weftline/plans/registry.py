"""Functions that jobs call by name: lists of DataFrames in, one DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import audit, events, images, linalg, merge, ml, routing, sort, text
from weftline.sources import files, sinks

Function = Callable[..., DataFrame]
FUNCTIONS: dict[str, Function] = {}


def function(name: str) -> Callable[[Function], Function]:
    """Registers f(inputs, **params) under `name`."""

    def add(f: Function) -> Function:
        if name in FUNCTIONS:
            raise ValueError(f"{name!r} is registered already")
        FUNCTIONS[name] = f
        return f

    return add


def lookup(name: str) -> Function:
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name!r}; there are {', '.join(sorted(FUNCTIONS))}")
    return FUNCTIONS[name]


def _one(f: Callable[[DataFrame], DataFrame]) -> Function:
    return lambda inputs, **params: f(inputs[0], **params)


function("words")(lambda inputs, column="value": text.words(inputs[0], column))
function("word_count")(lambda inputs, column="value": text.word_count(inputs[0], column))
function("count_words")(lambda inputs: inputs[0].groupBy("word").agg(F.count("*").alias("n")))
function("word_count_summary")(_one(text.summary))
function("tf_idf")(lambda inputs, column="value", top=50: text.tf_idf(inputs[0], column, top))
function("parse_trades")(_one(audit.trades))
function("audit")(lambda inputs: audit.audit(inputs[0], inputs[1]))
function("audit_rule")(lambda inputs, number: audit.rule(inputs[0], inputs[1], number))
function("audit_totals")(_one(audit.totals))
function("range_summary")(lambda inputs, ranges=8: sort.range_summary(inputs[0], ranges))
function("range_totals")(_one(sort.finalize))
function("sort_records")(lambda inputs, key="key", ties=(): sort.sorted_records(inputs[0], key, tuple(ties)))
function("long_samples")(_one(ml.long_samples))
function("train")(lambda inputs, classes=10, epochs=1: ml.train(inputs[0], classes, epochs))
function("infer")(lambda inputs: ml.infer(inputs[0], inputs[1]))
function("infer_arrays")(lambda inputs: ml.infer_arrays(inputs[0], inputs[1]))
function("fit")(lambda inputs, classes=10, epochs=10: ml.weights_frame(inputs[0].sparkSession, ml.fit(inputs[0], classes, epochs)))
function("accuracy")(_one(ml.accuracy))
function("stumps")(lambda inputs, classes=10: ml.stumps(inputs[0], classes))
function("vote")(lambda inputs, classes=10: ml.vote(inputs[0], inputs[1], classes))
function("pca")(lambda inputs, components=8: ml.pca(inputs[0], components))
function("multiply")(lambda inputs: linalg.multiply(inputs[0], inputs[1]))
function("multiply_blocks")(lambda inputs, block=256: linalg.multiply_blocks(inputs[0], inputs[1], block))
function("checksum")(_one(linalg.checksum))
function("review")(lambda inputs: events.review(inputs[0], inputs[1]))
function("social")(lambda inputs: events.social(inputs[0], inputs[1]))
function("even")(_one(events.even))
function("mark")(_one(events.mark))
function("round_summary")(_one(events.round_summary))
function("fixed_width")(lambda inputs, width=10: files.fixed_width(inputs[0], width))
function("split_contiguous")(lambda inputs, workers, order="seq": routing.split_contiguous(inputs[0], workers, order=order))
function("key_values")(lambda inputs, column="value": merge.key_values(inputs[0], column))
function("image_decode")(_one(images.decode))
function("image_pgm")(_one(sinks.pgm))
for _name in ("rotate", "grayscale", "equalize", "blur", "resize", "noop", "pipeline", "parse_netpbm"):
    function(f"image_{_name}")(_one(getattr(images, _name)))
function("scatter")(lambda inputs, slots: routing.scatter(inputs[0], slots))
function("count")(lambda inputs: inputs[0].agg(F.count("*").alias("n")))


@function("where")
def _where(inputs: Sequence[DataFrame], condition: str) -> DataFrame:
    return inputs[0].where(condition)


@function("select")
def _select(inputs: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return inputs[0].selectExpr(*columns)


@function("sql")
def _sql(inputs: Sequence[DataFrame], text: str) -> DataFrame:
    """`text` with inputs as {a}, {b}, ..."""
    return inputs[0].sparkSession.sql(text, **{chr(97 + i): df for i, df in enumerate(inputs)})
