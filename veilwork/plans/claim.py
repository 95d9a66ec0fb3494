"""One writer at a place: a claim file that only one run can create."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.layout import file_system


class PlaceTaken(RuntimeError):
    """Another run is writing, or ended without giving its claim back."""


class Claim:
    """The right to write below ``out``, held by one run at a time.

    The file is created without overwriting, which the file systems of a cluster
    do for one caller only (object stores that cannot need a table format).
    """

    def __init__(self, spark: SparkSession, out: str, run_id: str):
        self._spark, self.run_id = spark, run_id
        self._at, self._fs = file_system(spark, f"{out.rstrip('/')}/_claim")
        self._jvm = spark._jvm

    def holder(self) -> str | None:
        """The run that holds the claim."""
        if not self._fs.exists(self._at):
            return None
        stream = self._fs.open(self._at)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _create(self) -> bool:
        try:
            stream = self._fs.create(self._at, False)
        except Exception as e:
            if self._fs.exists(self._at):
                return False
            raise e
        stream.writeUTF(self.run_id)
        stream.close()
        return True

    def take(self, over: bool = False) -> None:
        """Become the writer; ``over`` takes the place of a run that did not give it back."""
        if self._create():
            return
        before = self.holder()
        if over:
            aside = self._jvm.org.apache.hadoop.fs.Path(f"{self._at.toString()}-{before}")
            # Of several who take over, one renames the file; whoever finds another's claim instead has come too late.
            if self._fs.rename(self._at, aside):
                self._fs.delete(aside, False)
                if self._create():
                    return
        raise PlaceTaken(f"run {before} holds the claim {self._at.toString()}")

    def check(self) -> None:
        """Raise if another run has taken over."""
        if self.holder() != self.run_id:
            raise PlaceTaken(f"run {self.run_id} lost its claim {self._at.toString()}")

    def release(self) -> None:
        if self.holder() == self.run_id:
            self._fs.delete(self._at, False)
