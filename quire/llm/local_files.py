"""Writing to a local or mounted folder without a process for every file.

Hadoop's local file system sets the permissions of each file and folder that it
makes by running chmod, three processes or more a file with its checksum. Until
such a process has become chmod it shares the memory of the JVM that it came
from, and whoever adds up the memory of an executor's processes (YARN, cgroup
tools) counts the whole heap twice. Tables between steps are many small files,
so they are written by a file system that sets permissions in the JVM and makes
no checksum files (Parquet is read without them). What a caller writes in the
same session gets the same files as ever, checksums too, by one that differs from
Hadoop's in that alone. Their few lines of Java are
compiled by the compiler that Spark has for its own generated code, and go to
the executors as Python modules do. Other file systems (hdfs, s3a) are as ever.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME, _CHECKED = "quire.LocalFiles", "quire.LocalFiles$Checked"
_JAVA = """
package quire;

public class LocalFiles extends org.apache.hadoop.fs.RawLocalFileSystem {
    public void setPermission(org.apache.hadoop.fs.Path path, org.apache.hadoop.fs.permission.FsPermission mode) throws java.io.IOException {
        java.nio.file.Path file = pathToFile(path).toPath();
        if (mode.getStickyBit() || !file.getFileSystem().supportedFileAttributeViews().contains("posix")) {
            super.setPermission(path, mode);
            return;
        }
        String each = mode.getUserAction().SYMBOL + mode.getGroupAction().SYMBOL + mode.getOtherAction().SYMBOL;
        java.nio.file.Files.setPosixFilePermissions(file, java.nio.file.attribute.PosixFilePermissions.fromString(each));
    }

    public static class Checked extends org.apache.hadoop.fs.LocalFileSystem {
        public Checked() {
            super(new LocalFiles());
        }
    }
}
"""

#: By application: the options of a write, none where the class can't be made.
_OPTIONS: dict[str, dict[str, str]] = {}


def _compiled(spark: SparkSession) -> dict[str, str]:
    """Compile the file system, send it to driver and executors."""
    jvm, sc = spark._jvm, spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(conf.getClassLoader())
    compiler.cook(_JAVA)
    jar = Path(tempfile.mkdtemp(prefix="quire-")) / "quire-local-files.jar"
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    sc._jsc.addJar(str(jar))
    urls = sc._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.net.URI(jar.as_uri()).toURL()
    conf.setClassLoader(jvm.java.net.URLClassLoader(urls, conf.getClassLoader()))
    return {"fs.file.impl": conf.getClassByName(_NAME).getName(), "fs.file.impl.disable.cache": "true"}


def write_options(spark: SparkSession, path: str) -> dict[str, str]:
    """Options for a write to ``path``: none unless that is a local folder and
    the session has chosen no file system for such. Other writes of the session
    then start no processes either."""
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    if files.getUri().getScheme() != "file" or conf.get("fs.file.impl"):
        return {}
    if sc.applicationId not in _OPTIONS:
        try:
            _OPTIONS[sc.applicationId] = _compiled(spark)
        except (Py4JJavaError, TypeError):  # no such compiler, or an older one
            _OPTIONS[sc.applicationId] = {}
    found = _OPTIONS[sc.applicationId]
    if found and spark.conf.get("fs.file.impl", None) is None:
        for key, value in (found | {"fs.file.impl": _CHECKED}).items():
            spark.conf.set(key, value)
    return found
