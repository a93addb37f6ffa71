"""Catalogue names and spellings in texts by one automaton (Aho-Corasick), for catalogues of any number of entries.

Looking for each entry by itself costs a pass over the text for every one of them; the automaton passes once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of all keys together, and entries, that an automaton (about 60 bytes a letter) may have to be sent to all tasks.
MOST_LETTERS, MOST_ENTRIES = 8_000_000, 500_000


def entry_table(spark: SparkSession, catalogue) -> DataFrame:
    """(ord, key, text, canonical, confidence, method) of a catalogue: its names, then its spellings."""
    rows = [(c.lower(), c, c, 0.85) for c in catalogue.canonical] + [(v, v, c, 0.82) for v, c in catalogue.variant_to_canonical().items()]
    return spark.createDataFrame([(i, *r, "dictionary") for i, r in enumerate(rows)], "ord int, key string, text string, canonical string, confidence double, method string")


def _checked(entries: DataFrame) -> list[tuple[int, str]]:
    """Keys and places, if they are few enough to be sent to all tasks; entries with an empty key occur nowhere."""
    usable = entries.where(F.length("key") > 0)
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("letters")).first()
    if size.n > MOST_ENTRIES or size.letters > MOST_LETTERS:
        raise ValueError(f"a catalogue of {size.n} entries and {size.letters} letters is too large for one automaton; cut it into several tables and join their hits")
    table = usable.select("ord", "key").toArrow()
    return list(zip(table["ord"].to_pylist(), table["key"].to_pylist()))


def entries_in(text: Column, entries: DataFrame) -> Column:
    """L4: array<int>, in order: ord of each entry whose key occurs anywhere in the lower-cased text; null for a null text."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for ord_, key in _checked(entries):
        places.setdefault(key, []).append(ord_)
    automaton = ahocorasick.Automaton()
    for key, at in places.items():
        automaton.add_word(key, at)
    if places:
        automaton.make_automaton()
    shared = entries.sparkSession.sparkContext.broadcast(automaton)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        built, out = shared.value, []
        for t in texts.to_pylist():
            out.append(None if t is None else sorted({o for _, at in built.iter(t) for o in at}) if len(built) else [])
        return pa.array(out, pa.list_(pa.int32()))

    return find(F.lower(text))


def dictionary_matches(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, text, canonical, confidence, method): a row for each entry of the catalogue that a document has. No text is shuffled."""
    hits = docs.select(F.col(key), F.explode(entries_in(F.col(text), entries)).alias("ord"))
    return hits.join(entries.drop("key"), "ord").select(key, "ord", "text", "canonical", "confidence", "method")
