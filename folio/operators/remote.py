"""A remote vision engine: images go out, answers are kept, and what has been answered is not asked again.

Answers are kept by the digest of the image, the instructions and the engine's version. A task writes
each answer down before it asks for the next, so that a job that was killed and is started again asks
only for what is open. Equal images are asked for once. Calls are dealt to lanes, each a task with
its share of the rate that the engine allows; however many of them run, the rate is not exceeded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions import text
from folio.operators.classify import answers_to_records, parse_answers
from folio.operators.merge import EngineUnavailable
from folio.sources.store import is_local, opened

#: Calls that a lane has under way at a time.
IN_FLIGHT = 3
KEPT = "digest string, modo string, versao string, resposta string"


class Refused(RuntimeError):
    """An engine's answer that asking again won't change, such as an invalid key."""


@dataclass(frozen=True)
class Request:
    """What an engine is asked: the image as its file's bytes (None: there is only the name)."""

    arquivo: str
    imagem: bytes | None
    instrucoes: str

    @property
    def base64(self) -> str:
        return base64.b64encode(self.imagem or b"").decode()

    @property
    def mime(self) -> str:
        return "image/jpeg" if (self.imagem or b"")[:2] == b"\xff\xd8" else "image/png"

    @property
    def schema(self) -> dict:
        """The JSON schema that an answer must follow."""
        kinds = {f: {"type": "boolean" if f == "e_planta" else "string"} for f in D.VLM_ANSWER.names}
        kinds["condicao"]["enum"], kinds["confianca"]["enum"] = D.CONDITIONS, D.VLM_CONFIDENCE
        return {"type": "object", "properties": kinds, "required": list(D.VLM_ANSWER.names)}


def checked(answer: dict | str) -> str:
    """An answer as JSON; ValueError unless it has all fields, of their types and in their domains."""
    found = json.loads(answer) if isinstance(answer, str) else answer
    for f in D.VLM_ANSWER.names:
        if not isinstance(found.get(f), bool if f == "e_planta" else str):
            raise ValueError(f"the answer has no {f}")
    if found["condicao"] not in D.CONDITIONS or found["confianca"] not in D.VLM_CONFIDENCE:
        raise ValueError("the answer is not in the form that was asked for")
    return json.dumps(found, ensure_ascii=False)


class Pace:
    """Lets calls of any threads through so many seconds apart."""

    def __init__(self, seconds: float):
        self.seconds, self._next, self._lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + self.seconds
        time.sleep(at - now)


def ask_with_patience(ask: Callable[[Request], dict | str], request: Request, pace: Pace, tries: int, wait: float, seed: str) -> tuple[str | None, str | None]:
    """(answer, error): asks again after an error, each time after about twice as long."""
    luck = random.Random(seed)
    for k in range(tries):
        pace.wait()
        try:
            return checked(ask(request)), None
        except Exception as e:  # the engine's, of any kind
            error = (str(e) or type(e).__name__).split("\n")[0]
            if isinstance(e, Refused):
                break
        if k + 1 < tries:
            time.sleep(wait * 2**k * luck.uniform(0.75, 1.25))
    return None, error


class AnswerStore:
    """Answers of an engine. Lines of JSON, a file for each attempt of a task (where files can't be
    appended to, for each answer), until compact() makes a Parquet table of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, base = opened(self.path)
        for folder in ("lines", "table"):
            fs.create_dir(f"{base}/{folder}", recursive=True)

    def answers(self) -> DataFrame:
        """(digest, modo, versao, resposta), one for each key. A line that was cut off doesn't count."""
        lines = self.spark.read.text(f"{self.path}/lines").select(F.from_json("value", KEPT).alias("a")).select("a.*")
        table = self.spark.read.schema(KEPT).parquet(f"{self.path}/table")
        return lines.filter("resposta IS NOT NULL").unionByName(table).groupBy("digest", "modo", "versao").agg(F.min("resposta").alias("resposta"))

    def compact(self) -> int:
        """Move all lines there are into the table; their number. Not while something is being asked."""
        fs, base = opened(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/lines"))]
        if old:
            lines = self.spark.read.text(f"{self.path}/lines").select(F.from_json("value", KEPT).alias("a")).select("a.*")
            lines.filter("resposta IS NOT NULL").write.mode("append").parquet(f"{self.path}/table")
        for path in old:
            fs.delete_file(path)
        return len(old)

    def writer(self) -> Callable[[dict], None]:
        """A function that writes an answer down for good before it returns; to be made in a task."""
        return _Lines(self.path)


class _Lines:
    def __init__(self, path: str):
        self.fs, base = opened(path)
        self.name, self.n, self.lock = f"{base}/lines/{uuid.uuid4().hex}", 0, threading.Lock()

    def __call__(self, answer: dict) -> None:
        line = (json.dumps(answer, ensure_ascii=False) + "\n").encode()
        with self.lock:
            self.n += 1
            if not is_local(self.fs):
                with self.fs.open_output_stream(f"{self.name}-{self.n}") as out:
                    out.write(line)
                return
            with open(self.name, "ab") as out:
                out.write(line)
                out.flush()
                os.fsync(out.fileno())


class RemoteEngine:
    """items(pos, arquivo[, imagem]) to records, by a function that is asked about each image.

    ask gets a Request and returns the answer, as a dict or JSON; it runs in tasks. per_minute: calls
    that all lanes together may make. A call is tried so often, with growing waits; if one fails in
    the end, the engine is unavailable for the batch, unless partial_ok: then the items without an
    answer are left out. What was answered stays answered in either case."""

    def __init__(self, store: AnswerStore, ask: Callable[[Request], dict | str], version: str = "remote", instructions: str = "", lanes: int = 2, in_flight: int = IN_FLIGHT, per_minute: float | None = None, tries: int = 3, wait: float = 1.0, partial_ok: bool = False):
        self.store, self.ask, self.version, self.instructions = store, ask, version, instructions
        self.lanes, self.in_flight, self.per_minute, self.tries, self.wait, self.partial_ok = lanes, in_flight, per_minute, tries, wait, partial_ok

    @property
    def mode(self) -> str:
        return hashlib.sha256(self.instructions.encode()).hexdigest()[:16]

    def _keyed(self, items: DataFrame) -> DataFrame:
        image = F.col("imagem") if "imagem" in items.columns else F.lit(None).cast("binary")
        return items.select("pos", "arquivo", image.alias("imagem")).withColumn("digest", F.coalesce(F.sha2("imagem", 256), F.sha2(F.concat(F.lit("name:"), F.col("arquivo")).cast("binary"), 256)))

    def _known(self) -> DataFrame:
        return self.store.answers().filter((F.col("modo") == self.mode) & (F.col("versao") == self.version)).select("digest", "resposta")

    def ask_open(self, items: DataFrame) -> list[str]:
        """Ask about what has no answer yet; the errors there were, at most one of each kind."""
        images = self._keyed(items).groupBy("digest").agg(F.min_by("arquivo", "pos").alias("arquivo"), F.min_by("imagem", "pos").alias("imagem"))
        still_open = images.join(self._known().select("digest"), "digest", "left_anti").repartition(self.lanes)
        store, ask, mode, version, instructions, in_flight, tries, wait = self.store.path, self.ask, self.mode, self.version, self.instructions, self.in_flight, self.tries, self.wait
        apart = 60 * self.lanes / self.per_minute if self.per_minute else 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep, pace = _Lines(store), Pace(apart)

            def one(row: tuple) -> str | None:
                digest, name, image = row
                answer, error = ask_with_patience(ask, Request(name, image, instructions), pace, tries, wait, digest)
                if answer is not None:
                    keep({"digest": digest, "modo": mode, "versao": version, "resposta": answer})
                return error

            with ThreadPoolExecutor(in_flight) as pool:
                for b in batches:
                    for at in range(0, b.num_rows, 4 * in_flight):  # few images are Python objects at once
                        rows = zip(*(c.to_pylist() for c in b.slice(at, 4 * in_flight).columns), strict=True)
                        errors = [e for e in pool.map(one, rows) if e is not None]
                        yield pa.RecordBatch.from_arrays([pa.array(errors, pa.string())], names=["erro"])

        return [r.erro for r in still_open.mapInArrow(run, "erro string").groupBy("erro").count().orderBy(F.desc("count"), "erro").limit(10).collect()]

    def __call__(self, items: DataFrame) -> DataFrame:
        errors = self.ask_open(items)
        if errors and not self.partial_ok:
            raise EngineUnavailable(errors[0])
        answered = self._keyed(items).drop("imagem").join(self._known(), "digest")
        return answers_to_records(parse_answers(answered).filter("valido"), text.now_iso(), self.version)
