"""Fixture frames shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import minus
from ..operators.coverage import articles_of_active, story_coverage
from ..plans.joins import spread
from ..sources import fixtures


TITLES = {"titulo_canonico": (F.min, "titulo"), "resumen_canonico": (F.max, "titulo")}


class News:
    """The news tables of one data folder; every frame is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def outlets(self) -> DataFrame:
        return fixtures.outlets(self.spark, self.folder)

    @cached_property
    def articles(self) -> DataFrame:
        return fixtures.articles(self.spark, self.folder)

    @cached_property
    def plain_articles(self) -> DataFrame:
        return fixtures.articles(self.spark, self.folder, titles=False)

    @cached_property
    def follows(self) -> DataFrame:
        return fixtures.follows(self.spark, self.folder)

    @cached_property
    def subscribers(self) -> DataFrame:
        return fixtures.subscribers(self.spark, self.folder)

    @cached_property
    def texts(self) -> DataFrame:
        return spread(fixtures.text_articles(self.spark, self.folder))

    @cached_property
    def vectors(self) -> DataFrame:
        return fixtures.vectors(self.spark, self.folder)

    @cached_property
    def coverage(self) -> DataFrame:
        return story_coverage(self.plain_articles, self.outlets)

    @cached_property
    def stories(self) -> DataFrame:
        return story_coverage(self.articles, self.outlets, TITLES)

    def coverage_of(self, window: str) -> DataFrame:
        """Coverage of the stories that were active in the window before ``as_of``."""
        return story_coverage(articles_of_active(self.plain_articles, minus(self.as_of, window)), self.outlets)

    def stories_of(self, window: str) -> DataFrame:
        return story_coverage(articles_of_active(self.articles, minus(self.as_of, window)), self.outlets, TITLES)

    @property
    def as_of(self):
        return fixtures.latest(self.plain_articles)
