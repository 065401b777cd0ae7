"""The corpus pipeline: five stages over ``documents``, each written before the next one reads it."""

import functools
import threading

from pyspark.sql import functions as F

from errorloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from errorloom.llm.common import Scratch, read, remainder, ship, stored


class _Tables(threading.local):
    """What the stages stored last, by the stage's name."""

    def __init__(self):
        self.of = {}


_tables = _Tables()


def stage(function):
    """A stage that begins by removing what the stage before it stored, as that one's rows are written by then."""

    @functools.wraps(function)
    def begun(spark, docs, sf_dir):
        ship(spark)
        order = [work.__name__ for _, work in STAGES]
        at = order.index(function.__name__)
        if at and order[at - 1] in _tables.of:
            _tables.of.pop(order[at - 1]).remove()
        with Scratch(spark) as own:
            _tables.of[function.__name__] = own
            return function(spark, docs, sf_dir)

    return begun


@stage
def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity machine does not reject."""
    model = toxicity.train(
        docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0
    )
    # Apart from the score's columns, whose names the documents may have too.
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_doc")
    return toxicity.score(docs.select(whole, "text"), model).where("predicted = 0").select("_doc.*")


@stage
def drop_copies(spark, docs, sf_dir):
    """One document of each text: that with the greatest id."""
    return exact_dedup.deduplicate(docs)


@stage
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of similar ones: that with the least id."""
    return jaccard.one_per_group(docs)


@stage
def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, mixing.words(F.col("text")))


@stage
def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack(stored(packing.pieces(docs), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Training, tokens and the choice of documents are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    read_last = Scratch(spark)
    for name, work in STAGES[:-1]:
        with Scratch(spark) as output:
            docs = stored(work(spark, docs, sf_dir), name.replace(" ", "-"))
        read_last.remove()
        read_last = output
    # The last stage stores the pieces and reads the documents no more.
    packed = STAGES[-1][1](spark, docs, sf_dir)
    read_last.remove()
    return packed
