"""The tagger in the executors' JVM, where Spark's vector module is there: Tagger.java, of which tagger.jar is compiled.

    javac --release 17 --add-modules jdk.incubator.vector -cp "$SPARK_HOME/jars/*" -d OUT Tagger.java, and OUT zipped
"""

from __future__ import annotations

import functools
import hashlib
import json
import pkgutil
import tempfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewatch.llm.pii import model

#: Characters whose windows are put in order of length together.
CHUNK = 500_000


def there(df: DataFrame) -> bool:
    """Whether the JVM of df's session has the vector module, as those that Spark starts have. A session of Spark Connect has no JVM here."""
    if not hasattr(df, "_jdf"):
        return False
    jvm = df.sparkSession._jvm
    return jvm.java.lang.ModuleLayer.boot().findModule("jdk.incubator.vector").isPresent()


@functools.cache
def jar() -> tuple[str, str]:
    """The path of tagger.jar as a file, wherever the package lies, and a name after its content."""
    data = pkgutil.get_data("tidewatch.llm.pii.jvm", "tagger.jar")
    name = f"tagger-{hashlib.sha256(data).hexdigest()[:16]}.jar"
    path = Path(tempfile.mkdtemp(prefix="tagger-"), name)
    path.write_bytes(data)
    return str(path), name


def added(spark: SparkSession) -> str:
    """The path of tagger.jar, of which the executors of the session get a copy."""
    path, name = jar()
    context = spark.sparkContext._jsc.sc()
    if name not in context.listJars().mkString(" "):
        context.addJar(path)
    return path


@functools.cache
def tagger_class(gateway, path: str):
    """The class, loaded once by the driver: py4j takes classes of one name for the same."""
    jvm = gateway.jvm
    urls = gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(path).toURI().toURL()
    return jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader()).loadClass("tidewatch.Tagger")


@functools.cache
def packed(trained) -> bytes:
    """The parameters as Tagger.java reads them; trained gives them and inputs() of them."""
    p, q = trained()
    assert p["u"].shape[1] == 32, "Tagger.java is written for 32 states a direction"
    floats = b"".join(np.ascontiguousarray(a, "<f4").tobytes() for a in (q["x"], q["u"], q["o"], q["c"], p["t"], p["s"], p["f"]))
    return zlib.compress(floats + model.table().astype("<u2").tobytes())


def with_spans(rows: DataFrame, column: int, schema: StructType, trained) -> DataFrame:
    """rows and the spans of the text in that column; schema is that of the result."""
    spark = rows.sparkSession
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    made = tagger_class(gateway, added(spark)).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    tagger = getattr(made, "with")(packed(trained), column, model.VOCABULARY, ",".join(model.KINDS), model.WINDOW, model.OVERLAP, CHUNK)
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(schema.jsonValue())))
    return DataFrame(rows._jdf.mapPartitions(tagger, encoder), spark)
