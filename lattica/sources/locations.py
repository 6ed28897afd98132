"""Where datasets lie: locations as Hadoop's file systems name them, and the settings of a store.

Settings of a store are Hadoop properties, from a properties file or a mapping. Credentials belong into a Hadoop
credential provider or an environment variable that the property refers to (`${env.NAME}`, which Hadoop resolves where
it is used): a credential property with its value in plain text is refused, so none ends up in a session's settings,
event log or command line.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Schemes that users write, where Hadoop's own name is another. Fixed values.
ALIASES = {"dir": "file", "s3": "s3a", "az": "abfss", "azure": "abfss"}

#: Schemes whose file systems Spark's Hadoop client has or takes as a plug-in. Fixed values.
KNOWN = {"file", "s3a", "abfss", "gs", "hdfs", "http", "https", "viewfs"}

#: Ends of the names of Hadoop's credential properties (S3A, ABFS). Fixed values.
CREDENTIALS = ("access.key", "secret.key", "session.token", "client.secret", "sas.fixed.token")


def resolve(location: str) -> str:
    """A location as a URI that Spark reads and writes; a plain path stays as it is."""
    scheme, found, rest = location.partition("://")
    if not found:
        return location
    hadoop = ALIASES.get(scheme, scheme)
    if hadoop not in KNOWN:
        raise ValueError(f"no file system for {scheme}://")
    return f"{hadoop}://{rest}"


def _is_credential(name: str) -> bool:
    return name.endswith(CREDENTIALS) or name.startswith("fs.azure.account.key.")


def configure(spark: SparkSession, settings: str | Mapping[str, str]) -> None:
    """Apply a store's settings to the session's Hadoop configuration. settings: Hadoop properties, or a file of them."""
    if isinstance(settings, str):
        lines = [r[0].strip() for r in spark.read.text(resolve(settings)).toLocalIterator()]
        settings = {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and not x.startswith("#"))}
    plain = [n for n, v in settings.items() if _is_credential(n) and not (v.startswith("${env.") and v.endswith("}"))]
    if plain:
        raise ValueError(f"credentials in plain text: {', '.join(plain)}; use a credential provider or ${{env.NAME}}")
    for name, value in settings.items():
        spark._jsc.hadoopConfiguration().set(name, value)
