"""The library and the work queue as objects over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplane.operators import search, tracker
from cliplane.operators.postings import SearchIndex

OBJECTS = "id string, status string, title string, type string, added_at long, attempts int, completed_at long, last_error string, last_attempt long, file_path string, updated_at timestamp"


class Library:
    """The video library over a table or a path of Parquet files. Changes make a new library."""

    def __init__(self, videos: DataFrame):
        self.videos = videos

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Library:
        return cls(spark.read.parquet(path))

    def list(self, skip: int = 0, limit: int = search.PAGE) -> DataFrame:
        return search.listed(self.videos, skip, limit)

    def get(self, video_id: int) -> DataFrame:
        return search.detail(self.videos, video_id)

    def search(self, q: str, category: str | None = None, min_score: int | None = None, skip: int = 0, limit: int = search.PAGE) -> DataFrame:
        return search.search(self.videos, q, category, min_score, skip, limit)

    def count(self, q: str, category: str | None = None, min_score: int | None = None) -> int:
        return search.found_by(self.videos, q, category, min_score).count()

    def analysis(self, video_id: int) -> DataFrame:
        return search.analysis_view(self.videos.filter(self.videos.video_id == video_id))

    def stats(self) -> DataFrame:
        return search.library_stats(self.videos)


    def insert(self, new: DataFrame) -> Library:
        """With the rows whose id isn't there yet; of new rows with one id the one that is smallest by all columns."""
        fresh = search.insert(self.videos, new).filter("not duplicate").drop("duplicate")
        first = fresh.groupBy("video_id").agg(F.min(F.struct(*new.columns)).alias("row")).select("row.*")
        return Library(self.videos.unionByName(first, allowMissingColumns=True))

    def update(self, changes: DataFrame) -> Library:
        return Library(search.update(self.videos, changes, "video_id"))

    def delete(self, ids: DataFrame) -> Library:
        return Library(search.delete(self.videos, ids, "video_id"))


class IndexedLibrary(Library):
    """The library behind a trigram index: searches test only rows that may hold the pattern, and inserts add to the index."""

    def __init__(self, index: SearchIndex):
        super().__init__(index.videos())
        self.index = index

    def search(self, q: str, category: str | None = None, min_score: int | None = None, skip: int = 0, limit: int = search.PAGE) -> DataFrame:
        return search.search(self.index.candidates(q), q, category, min_score, skip, limit)

    def count(self, q: str, category: str | None = None, min_score: int | None = None) -> int:
        return search.found_by(self.index.candidates(q), q, category, min_score).count()

    def insert(self, new: DataFrame) -> IndexedLibrary:
        """With the rows whose id isn't there yet; of new rows with one id the one that is smallest by all columns."""
        fresh = search.insert(self.videos, new).filter("not duplicate").drop("duplicate")
        first = fresh.groupBy("video_id").agg(F.min(F.struct(*new.columns)).alias("row")).select("row.*")
        return IndexedLibrary(self.index.insert(first))


class Tracker:
    """The work queue. Changes make a new queue; ``save`` writes it where a reader expects it."""

    def __init__(self, objects: DataFrame):
        self.objects = objects

    @classmethod
    def empty(cls, spark: SparkSession) -> Tracker:
        return cls(spark.createDataFrame([], OBJECTS))

    def add(self, new: DataFrame, now: int) -> Tracker:
        return Tracker(tracker.add_objects(self.objects, new, now))

    def completed(self, done: DataFrame, now: int) -> Tracker:
        return Tracker(tracker.mark_completed(self.objects, done, now))

    def failed(self, errors: DataFrame, now: int) -> Tracker:
        return Tracker(tracker.mark_error(self.objects, errors, now))

    def reset_errors(self) -> Tracker:
        return Tracker(tracker.reset_errors(self.objects))

    def reset_all(self) -> Tracker:
        return Tracker(tracker.reset_all(self.objects))

    def clear(self, ids: DataFrame | None = None) -> Tracker:
        return Tracker(tracker.clear(self.objects, ids))

    def status(self, object_id: str) -> DataFrame:
        return tracker.status_of(self.objects, object_id)

    def is_completed(self, ids: DataFrame) -> DataFrame:
        return tracker.is_completed(self.objects, ids)

    def errors(self) -> DataFrame:
        return tracker.errors(self.objects)

    def all_completed(self) -> DataFrame:
        return tracker.completed(self.objects)

    def rates(self) -> DataFrame:
        return tracker.rates(self.objects)

    def pending(self, kind: str = "all", limit: int | None = 100) -> DataFrame:
        return tracker.pending(self.objects, kind, limit)

    def stats(self, kind: str = "all") -> DataFrame:
        return tracker.stats(self.objects, kind)

    def summary(self) -> DataFrame:
        return tracker.stats_summary(self.objects)

    def save(self, path: str) -> None:
        self.objects.write.mode("overwrite").parquet(path)
