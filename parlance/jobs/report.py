"""The report of every community: tidy tables, checked before any is written."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.config import DEFAULT, Settings
from parlance.functions.plans import forget, keep
from parlance.jobs import sink
from parlance.operators import classes, community, lexicon, messages, movement, people, topics, units

# Field names that no published table may hold.
FORBIDDEN = frozenset({
    "message",
    "content",
    "author",
    "username",
    "nickname",
    "user_id",
    "message_id",
    "message_url",
    "url",
    "attachments",
    "reply_to",
    "member_alias_tokens",
})


def forbidden_fields(kind: T.DataType, path: str = "root") -> list[str]:
    """Paths of forbidden names in a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in ([f"{path}.{f.name}"] if f.name in FORBIDDEN else []) + forbidden_fields(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return forbidden_fields(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return forbidden_fields(kind.valueType, f"{path}{{}}")
    return []


def validate(df: DataFrame) -> DataFrame:
    """Fail on forbidden field names, and on forbidden keys of top-level maps."""
    if found := forbidden_fields(df.schema):
        raise RuntimeError(f"forbidden field at {', '.join(found)}")
    for f in df.schema:
        if isinstance(f.dataType, T.MapType):
            bad = F.exists(F.map_keys(f.name), lambda k: k.isin(*FORBIDDEN))
            df = df.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"forbidden key in {f.name}"))).otherwise(F.col(f.name)))
    return df


class Report:
    """The tables of a report over canonical messages, each built on demand."""

    def __init__(self, stored: DataFrame, words: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT, roster: DataFrame | None = None, scaffolding: DataFrame | None = None):
        self.settings, self.stored, self.roster, self.scaffolding = settings, stored, roster, scaffolding
        self._words, self._pairs = words, pairs
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Compute a table that many others read; ``close`` removes it."""
        self.held.append(keep(df))
        return self.held[-1]

    @cached_property
    def reference_words(self) -> DataFrame:
        return self.keep(self._words)

    @cached_property
    def reference_pairs(self) -> DataFrame:
        return self.keep(self._pairs)

    @cached_property
    def tokens(self) -> DataFrame:
        return self.keep(messages.tokenized(self.stored, self.settings))

    @cached_property
    def current(self) -> DataFrame:
        return self.tokens.where("is_current")

    @cached_property
    def aliases(self) -> DataFrame:
        return self.keep(messages.member_aliases(self.stored, self.roster))

    @cached_property
    def classes(self) -> DataFrame:
        return self.keep(classes.word_classes(self.stored.sparkSession, self.settings, self.scaffolding))

    @cached_property
    def facts(self) -> DataFrame:
        """Base facts of the current window."""
        return self.keep(messages.term_facts(self.current))

    @cached_property
    def window_words(self) -> DataFrame:
        return self.keep(messages.inventory(messages.term_facts(self.current, (1,)), True))

    @cached_property
    def window_phrases(self) -> DataFrame:
        """Phrases of the window that have the uses a published phrase needs."""
        return self.keep(messages.phrase_inventory(self.current, self.settings.min_phrase_uses, hold=self.keep))

    @cached_property
    def history(self) -> DataFrame:
        """Words of the whole history and its repeated phrases, with their uses in both periods."""
        return self.keep(messages.history_terms(self.tokens, self.settings, self.keep))

    @cached_property
    def totals(self) -> DataFrame:
        return self.keep(messages.totals(self.tokens))

    @cached_property
    def all_totals(self) -> DataFrame:
        return messages.totals(self.tokens, False)

    def people(self) -> DataFrame:
        return messages.people_activity(self.tokens)

    @cache
    def vocabulary(self) -> DataFrame:
        return self.keep(lexicon.vocabulary(self.window_words, self.totals, self.reference_words, self.classes, self.aliases, self.settings))

    @cache
    def lexicon(self) -> DataFrame:
        return lexicon.lexicon(self.vocabulary(), self.settings)

    @cache
    def phrases(self) -> DataFrame:
        gated = lexicon.gated_phrases(self.window_phrases, self.vocabulary(), self.totals, self.settings)
        return self.keep(lexicon.phrases(gated, self.reference_pairs, self.settings))

    def bigrams(self) -> DataFrame:
        return lexicon.qualified_bigrams(self.phrases(), self.settings)

    def observed(self) -> DataFrame:
        return self.window_words

    @cache
    def graph(self) -> dict[str, DataFrame]:
        """Units, nodes and edges; ``bigrams`` and ``units`` are read many times."""
        s, observed = self.settings, self.observed()
        bigrams = self.keep(self.bigrams())
        rows = self.keep(units.unit_rows(self.tokens, bigrams))
        facts = self.keep(units.unit_facts(rows))
        canonical = self.keep(units.canonical_facts(facts, observed))
        inventory = self.keep(units.unit_inventory(canonical, self.totals))
        nodes = self.keep(topics.nodes(inventory, self.totals, self.reference_words, self.classes, self.aliases, bigrams, s))
        surface = units.folded(facts.select("server_id", "term", "kind").distinct(), observed)
        canon = F.when(F.col("kind") == "word", F.col("canonical")).otherwise(F.col("term"))
        pairing = surface.select("server_id", "term", canon.alias("canonical")).join(nodes.select("server_id", F.col("term").alias("canonical")), ["server_id", "canonical"], "left_semi")
        near = self.keep(units.pair_documents(rows, pairing, s.pair_distance))  # read three times
        pairs = self.keep(units.canonical_pairs(near, observed, bigrams))
        days = topics.with_composition(pairs, facts, bigrams, nodes, observed)
        days = self.keep(days)
        edges = self.keep(topics.edges(days, nodes, self.totals, s))
        return {"days": days, "bigrams": bigrams, "rows": rows, "facts": facts, "canonical": canonical, "inventory": inventory, "nodes": nodes, "pairs": pairs, "edges": edges, "pruned": topics.strongest(edges, s.node_links)}

    @cache
    def topic_communities(self) -> DataFrame:
        """Communities of the pruned graph, whose nodes are bounded, so a server is a group."""
        return self.keep(community.communities(self.graph()["pruned"], self.settings.topic_resolution, split=False))

    @cache
    def topics(self) -> tuple[DataFrame, DataFrame]:
        g = self.graph()
        found, members = topics.families(g["nodes"], g["pruned"], self.topic_communities(), g["canonical"], self.observed(), self.settings)
        return self.keep(found), self.keep(members)

    @cached_property
    def here(self) -> DataFrame:
        return self.keep(people.participation(self.tokens))

    @cache
    def links(self) -> DataFrame:
        """The strongest links of each person."""
        return people.strongest_links(self.here, self.settings.person_links)

    @cache
    def person_communities(self) -> DataFrame:
        return self.keep(community.communities(self.links(), self.settings.circle_resolution))

    @cache
    def circles(self) -> DataFrame:
        return self.keep(people.circles(self.person_communities(), self.people()))

    def allowed(self) -> DataFrame:
        return topics.allowed_words(self.lexicon(), self.topics()[1], self.settings)

    def mix(self, key: str, groups: DataFrame | None = None) -> DataFrame:
        """Topic mix by speaker, channel or a grouping of speakers."""
        counts = people.unit_counts(self.graph()["facts"], key, groups)
        return topics.topic_mix(counts, self.topics()[1], key, self.observed(), self.settings)

    def contributions(self) -> DataFrame:
        return lexicon.contributions(self.facts, self.lexicon(), self.phrases())

    def people_table(self) -> DataFrame:
        return people.people_table(self.people(), self.here, self.mix("speaker"), self.contributions())

    def channel_language(self) -> DataFrame:
        counts = messages.roll_up(self.facts.where("size = 1"), "channel", "term")
        sizes = self.current.groupBy("server_id", "channel").agg(F.sum(F.size("tokens")).alias("size"))
        return people.distinctive(counts, "channel", sizes, self.observed(), self.allowed(), self.totals, voices=False)

    def circle_language(self) -> DataFrame:
        counts, sizes = people.circle_words(self.facts, self.people(), self.circles())
        return people.distinctive(counts, "circle", sizes, self.observed(), self.allowed(), self.totals, voices=True)

    def circle_channels(self) -> DataFrame:
        return people.circle_channels(self.circles(), self.here)

    def circle_table(self) -> DataFrame:
        rooms, mix = self.circle_channels(), self.mix("circle", self.circles())
        return people.circle_table(self.circles(), rooms, people.circle_labels(rooms, mix), mix, self.circle_language(), self.totals)

    def channel_table(self) -> DataFrame:
        return people.channel_profiles(self.here, self.people(), self.mix("channel"), self.channel_language())

    def visible_edges(self) -> DataFrame:
        return topics.visible_edges(self.graph()["edges"], self.topics()[1], self.settings)

    def moves(self) -> DataFrame:
        """Movement candidates over the whole history."""
        words = self.keep(classes.classed(self.history.where("size = 1"), self.classes, self.aliases))
        gated = lexicon.gated_phrases(self.history, words.withColumn("about", F.lit(False)), self.all_totals, self.settings)
        return movement.candidates(words, movement.periods(self.tokens, self.settings), gated, self.settings)

    def movement(self) -> DataFrame:
        return movement.diverse(movement.directed(self.moves()), self.history.where("size = 1"))

    def tables(self) -> dict[str, DataFrame]:
        g = self.graph()
        found, members = self.topics()
        activity = self.keep(messages.daily_activity(self.tokens, self.settings))
        shown = self.keep(self.visible_edges())
        raw = messages.eligible(self.stored, self.settings)
        out = {
            "stats": self.totals, "activity": activity, "heat_map": messages.heat_map(self.tokens), "lexicon": self.lexicon(),
            "phrases": self.phrases(), "topics": found, "units": members, "series": topics.topic_series(members, g["canonical"], activity),
            "edges": shown, "edge_series": topics.edge_series(shown, g["days"], activity), "movement": self.movement(),
            "sources": messages.link_domains(raw, 20), "source_series": messages.domain_series(raw, activity),
            "people": people.pseudonymous(self.people_table()), "circles": self.circle_table(), "channels": self.channel_table(),
            "servers": messages.server_index(self.stored), "coverage": messages.coverage(self.stored).where("server_id is not null"),
        }
        if {"reactions", "attachments"} <= set(self.stored.columns):
            current = messages.eligible(self.stored, self.settings, ("reactions", "attachments")).where("is_current")
            out["symbols"] = messages.symbols(current, 20)
        return out

    def write(self, path: str, versions: int = 3) -> str:
        """Validate every table, write all to a new version, then publish it; returns the version.

        A failure on the way leaves the published report as it was.
        """
        return sink.publish(self.stored.sparkSession, {name: validate(df) for name, df in self.tables().items()}, path, versions)

    def close(self) -> None:
        """Remove the tables kept on the way; the report can not be used after."""
        forget(self.stored.sparkSession, *self.held)
        self.held.clear()

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the report published last."""
    return sink.read_table(spark, path, name)
