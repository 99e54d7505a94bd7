"""Files of the engine, all through Hadoop's file systems, so that any store will do."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and there is one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="engine-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/engine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._publish(fs, tmp, p):
            fs.delete(tmp, False)
            return False
        return True

    def _publish(self, fs, tmp, p) -> bool:
        """Give a written file its name; of several writers one succeeds."""
        if fs.getUri().getScheme() == "file":
            # A local rename would replace what is there; a link fails.
            at = lambda path: self.jvm.java.io.File(path.toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(at(p), at(tmp))
            except Py4JJavaError:
                return False
            fs.delete(tmp, False)
            return True
        return not fs.exists(p) and fs.rename(tmp, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
