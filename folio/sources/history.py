"""The history of records: a log's current rows, and a store that several writers may commit to."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio import domain as D
from folio.functions import text
from folio.sources.store import opened, put_if_absent, removed

COLUMNS = ["arquivo", "data_hora", "motor", "especie", "diagnostico", "condicao", "confianca", "confianca_texto", "agente", "sintomas", "manejo", "observacoes", "modelo_versao", "miniatura"]
KINDS = {"confianca": T.DoubleType(), "miniatura": T.BinaryType()}
REQUIRED = ("arquivo", "data_hora", "motor")
#: Rows of a batch: ids after compact(), places in their file before; imagem is a picture's digest.
STORED = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("ordem", T.IntegerType()), T.StructField("imagem", T.StringType()), T.StructField("ranking", D.RANKING), *[T.StructField(c, KINDS.get(c, T.StringType())) for c in COLUMNS[:-1]]])


def filled(rows: DataFrame) -> DataFrame:
    """History rows as records: null and empty become "—" or "", and there is no ranking."""
    dash = {"especie", "diagnostico", "confianca_texto", "agente", "modelo_versao"}
    empty = {"condicao", "sintomas", "manejo", "observacoes"}
    keep = [c for c in rows.columns if c != "miniatura"]
    return rows.select(*[text.missing_to(F.col(c), "—").alias(c) if c in dash else text.missing_to(F.col(c), "").alias(c) if c in empty else F.col(c) for c in keep])


def current(log: DataFrame) -> DataFrame:
    """What a log holds now. The last clear is one number, looked up first; Spark chooses how to
    join inserts and deletes."""
    cleared = log.filter("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    gone = log.filter("op = 'delete'").select("id").distinct()
    return log.filter((F.col("op") == "insert") & (F.col("seq") > cleared)).join(gone, "id", "left_anti")


@dataclass
class Batch:
    """A folder of rows that one commit added. Of each file: name, rows, first and last id."""

    data: str
    files: list[tuple[str, int, int, int]]

    @property
    def count(self) -> int:
        return sum(f[1] for f in self.files)


@dataclass
class State:
    """What the commits up to a version amount to."""

    version: int = 0
    next_id: int = 1
    batches: list[Batch] = field(default_factory=list)
    gone: set[int] = field(default_factory=set)
    #: Of numbered batches of a source: the last number.
    done: dict[str, int] = field(default_factory=dict)

    def apply(self, version: int, c: dict) -> None:
        self.version = version
        if c["op"] == "insert":
            # Ids are given by the order of commits: files hold places in their batch only.
            shifted = [(name, n, lo + self.next_id, hi + self.next_id) for name, n, lo, hi in c["files"]]
            self.batches.append(Batch(c["data"], shifted))
            self.next_id += sum(f[1] for f in shifted)
            if c.get("source") is not None:
                self.done[c["source"]] = c["number"]
        elif c["op"] == "delete":
            self.gone.add(c["id"])
        elif c["op"] == "clear":
            self.batches, self.gone = [], set()
        elif set(c["replaces"]) <= {b.data for b in self.batches}:  # else another one came first, or a clear
            kept = [b for b in self.batches if b.data not in c["replaces"]]
            self.batches = [Batch(c["data"], [tuple(f) for f in c["files"]]), *kept]
            self.gone -= set(c["folds"])

    def has(self, numbered: tuple[str, int] | None) -> bool:
        return numbered is not None and self.done.get(numbered[0], -1) >= numbered[1]

    def total(self) -> int:
        return sum(b.count for b in self.batches) - len(self.gone)

    def file_of(self, id_: int) -> tuple[Batch, tuple[str, int, int, int]] | None:
        """The only file that may hold an id."""
        found = ((b, f) for b in self.batches for f in b.files if f[2] <= id_ <= f[3])
        return None if id_ in self.gone else next(found, None)


class History:
    """The history as batches of Parquet files and a log of numbered commits.

    A writer first writes its rows, with their places from 0 in the batch, where nobody looks; then
    it puts a commit under the next number, if nobody has put one there, and else takes the number
    after. Ids are places plus what the commits before amount to, so they are dense and in the order
    of the batch, and no row is written twice for a number that was lost. Ids are never used twice.

    Pictures are kept once each, by their digest, in a table of their own. compact() writes all rows
    that are left anew; it is called when commits or deletes pile up, so that the number of batches and
    of deletes that readers see is bounded. Its snapshot of the state is where readers of the log begin.
    """

    #: Batches and deletes that are left before all is written anew.
    MOST_BATCHES, MOST_DELETES = 64, 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, base = opened(self.path)
        for folder in ("log", "data", "pictures"):
            fs.create_dir(f"{base}/{folder}", recursive=True)

    # The log

    def state(self) -> State:
        fs, base = opened(self.path)
        names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{base}/log")) if f.base_name[0] != ".")
        state = State()
        for name in [n for n in names if n.endswith(".state")][-1:]:
            raw = self._read_log(name)
            state = State(raw["version"], raw["next_id"], [Batch(b["data"], [tuple(f) for f in b["files"]]) for b in raw["batches"]], set(raw["gone"]), raw["done"])
        for name in names:
            if name.endswith(".json") and int(name[:-5]) > state.version:
                state.apply(int(name[:-5]), self._read_log(name))
        return state

    def _read_log(self, name: str) -> dict:
        fs, base = opened(self.path)
        with fs.open_input_stream(f"{base}/log/{name}") as f:
            return json.loads(f.read())

    def _put(self, version: int, commit: dict) -> None:
        put_if_absent(self.spark, f"{self.path}/log/{version:020d}.json", json.dumps(commit).encode())

    def _commit(self, make: Callable[[State], dict | None]) -> tuple[State, dict | None]:
        """Put what make() makes of the state under the next number, as often as it takes; make() returns
        nothing if there is nothing to do. The state before, and what was put."""
        while True:
            state = self.state()
            commit = make(state)
            try:
                if commit is not None:
                    self._put(state.version + 1, commit)
                return state, commit
            except FileExistsError:
                continue

    # Writing

    def save(self, record: dict, thumbnail: bytes | None = None) -> int:
        """Insert one record; its id."""
        row = self.spark.createDataFrame([tuple(record.get(c) for c in COLUMNS[:-1])], T.StructType([T.StructField(c, KINDS.get(c, T.StringType())) for c in COLUMNS[:-1]]))
        for c in REQUIRED:
            if record.get(c) is None:
                raise ValueError(f"{c} is required")
        pictures = None if thumbnail is None else self.spark.createDataFrame([(0, bytearray(thumbnail))], "pos bigint, miniatura binary")
        return self.save_all(row.withColumn("pos", F.lit(0)), pictures)[1]

    def save_all(self, records: DataFrame, pictures: DataFrame | None = None, numbered: tuple[str, int] | None = None) -> tuple[DataFrame, int]:
        """Insert records in the order of pos and ordem, where they have them; (what was inserted as records,
        with id_historico, pos and ordem; the first id, 0 if there is none). Without arquivo, data_hora or
        motor a record is an error.

        pictures(pos, miniatura): a picture for each item; records of one item share it. numbered: a source
        and the number of its batch; what is not above the source's last number is not inserted again."""
        have = set(records.columns)
        if missing := set(REQUIRED) - have:
            raise ValueError(f"{sorted(missing)[0]} is required")
        if self.state().has(numbered):
            return self._records([]), 0
        if pictures is not None:
            pictures = pictures.filter("miniatura IS NOT NULL").withColumn("imagem", F.sha2("miniatura", 256))
            self._add_pictures(pictures)
            records = records.drop("imagem").join(pictures.groupBy("pos").agg(F.min("imagem").alias("imagem")), "pos", "left")
            have.add("imagem")
        value = lambda c: F.col(c) if c in have else F.lit(None)
        required = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"{c} is required")).cast("string"))
        rows = records.select(*[(required(f.name) if f.name in REQUIRED else value(f.name).cast(f.dataType)).alias(f.name) for f in STORED if f.name not in ("id", "at")])
        order = [c for c in ("pos", "ordem") if c in have]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        data = uuid.uuid4().hex
        folder = f"{self.path}/data/{data}"
        rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(folder)
        files, at = [], 0
        for name, n, *_ in self._files(folder, F.lit(0)):
            files.append((name, n, at, at + n - 1))
            at += n
        source, number = numbered or (None, None)
        put = {"op": "insert", "data": data, "files": files, "source": source, "number": number}
        state, commit = self._commit(lambda s: None if s.has(numbered) else put)
        if commit is None:
            return self._records([]), 0
        state.apply(state.version + 1, commit)
        self._tidy()
        added = state.batches[-1]
        return self._records([added]), min((f[2] for f in added.files), default=0)

    def _records(self, batches: list[Batch]) -> DataFrame:
        """What batches hold, as records with their ids."""
        return self._read(batches).withColumnRenamed("id", "id_historico").drop("imagem")

    def _files(self, folder: str, id_: Column) -> list[tuple[str, int, int, int]]:
        """Name, rows, first and last id of each file of a folder, in the files' order."""
        found = self.spark.read.schema(STORED).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*"), F.min(id_), F.max(id_))
        return sorted(map(tuple, found.collect()))

    def _add_pictures(self, pictures: DataFrame) -> None:
        """Those that are not there yet, once each. Two writers may both add one; readers take either."""
        new = pictures.groupBy("imagem").agg(F.first("miniatura").alias("miniatura"))
        new = new.join(self._pictures().select("imagem"), "imagem", "left_anti")
        new.sortWithinPartitions("imagem").write.mode("append").parquet(f"{self.path}/pictures")

    def _pictures(self) -> DataFrame:
        return self.spark.read.schema("imagem string, miniatura binary").parquet(f"{self.path}/pictures")

    def delete(self, id_: int) -> bool:
        _, commit = self._commit(lambda s: {"op": "delete", "id": id_} if self._row(s, id_) else None)
        if commit is not None:
            self._tidy()
        return commit is not None

    def clear(self) -> int:
        state, _ = self._commit(lambda s: {"op": "clear"})
        return state.total()

    def _tidy(self) -> None:
        state = self.state()
        if len(state.batches) > self.MOST_BATCHES or len(state.gone) > self.MOST_DELETES:
            self.compact()

    def compact(self) -> bool:
        """Write all rows that are left as one batch, ordered by id; whether that was put. What other
        writers insert meanwhile stays; if one clears or compacts first, nothing is put."""
        before = self.state()
        if not before.batches:
            return False
        data = uuid.uuid4().hex
        rows = self._live(before).withColumn("at", F.lit(None).cast("bigint"))
        folder = f"{self.path}/data/{data}"
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(folder)
        files = self._files(folder, F.col("id"))
        replaces = [b.data for b in before.batches]
        put = {"op": "snapshot", "data": data, "files": files, "replaces": replaces, "folds": sorted(before.gone)}
        _, commit = self._commit(lambda s: put if set(replaces) <= {b.data for b in s.batches} else None)
        if commit is None:
            return False
        after = self.state()
        whole = {"version": after.version, "next_id": after.next_id, "batches": [{"data": b.data, "files": b.files} for b in after.batches], "gone": sorted(after.gone), "done": after.done}
        with contextlib.suppress(FileExistsError):  # the same, by another writer
            put_if_absent(self.spark, f"{self.path}/log/{after.version:020d}.state", json.dumps(whole).encode())
        return True

    def vacuum(self, older_than_hours: float = 24) -> int:
        """Remove folders of rows that no commit names any more, or never did, if they are that old; how
        many. Readers of an older state must be done by then."""
        fs, base = opened(self.path)
        used, removed_ = {b.data for b in self.state().batches}, 0
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/data")):
            if f.base_name not in used and f.mtime_ns is not None and time.time() - f.mtime_ns / 1e9 >= older_than_hours * 3600:
                removed(f"{self.path}/data/{f.base_name}")
                removed_ += 1
        return removed_

    # Reading

    def _read(self, batches: list[Batch], only: list[str] | None = None) -> DataFrame:
        """Rows of batches, or of only these of their files, with ids, deleted ones too."""
        paths = [f"{self.path}/data/{b.data}" if only is None else f"{self.path}/data/{b.data}/{name}" for b in batches for name in ([""] if only is None else only)]
        if not any(b.files for b in batches):
            return self.spark.createDataFrame([], STORED).drop("at")
        d = self.spark.read.schema(STORED).parquet(*[p.rstrip("/") for p in paths])
        # A row for each file: no more than there are batches, which compact() bounds, and their files.
        firsts = self.spark.createDataFrame([(name, lo) for b in batches for name, _, lo, _ in b.files if only is None or name in only], "_f string, _first bigint")
        d = d.withColumn("_f", F.col("_metadata.file_name")).join(F.broadcast(firsts), "_f")
        return d.withColumn("id", F.coalesce("id", F.col("_first") + F.col("at"))).select(*[c for c in STORED.names if c != "at"])

    def _live(self, state: State) -> DataFrame:
        d = self._read(state.batches)
        return d.filter(~F.col("id").isin(sorted(state.gone))) if state.gone else d

    @property
    def rows(self) -> DataFrame:
        """(id, the record's columns) of all that is there, without pictures."""
        return self._live(self.state()).select("id", *COLUMNS[:-1])

    def thumbnails(self) -> DataFrame:
        """(id, miniatura) of all records that have a picture."""
        pictures = self._pictures().groupBy("imagem").agg(F.first("miniatura").alias("miniatura"))
        return self._live(self.state()).select("id", "imagem").join(pictures, "imagem").select("id", "miniatura")

    def page(self, limit: int = 60) -> DataFrame:
        """The newest records, without thumbnails; a negative limit is none."""
        rows = self.rows.withColumn("data_legivel", text.human_date(F.col("data_hora"))).orderBy(F.desc("id"))
        return rows if limit < 0 else rows.limit(limit)

    def _row(self, state: State, id_: int):
        found = state.file_of(id_)
        return found and self._read([found[0]], [found[1][0]]).filter(F.col("id") == id_).first()

    def get(self, id_: int) -> dict | None:
        """One record; reads the only file that may hold it."""
        found = self.state().file_of(id_)
        if not found:
            return None
        rows = self._read([found[0]], [found[1][0]]).filter(F.col("id") == id_)
        row = rows.select("id", *COLUMNS[:-1], text.human_date(F.col("data_hora")).alias("data_legivel")).first()
        return row.asDict() if row else None

    def thumbnail(self, id_: int) -> bytes | None:
        row = self._row(self.state(), id_)
        picture = row and row.imagem and self._pictures().filter(F.col("imagem") == row.imagem).select("miniatura").first()
        return bytes(picture[0]) if picture else None

    def total(self) -> int:
        return self.state().total()

    def records(self) -> DataFrame:
        """All of it as records, by id, for exports."""
        empty = F.array().cast("array<struct<id_classe string, confianca double>>")
        return filled(self.rows).withColumn("ranking", empty).withColumn("pos", F.col("id")).orderBy("id")
