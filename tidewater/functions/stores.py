"""Opening paths from tasks, with the session's settings: Hadoop's names of stores and their keys, as pyarrow takes them."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Settings of Hadoop's connectors that workers need.
_S3 = ("access.key", "secret.key", "session.token", "endpoint", "endpoint.region", "path.style.access", "connection.ssl.enabled", "assumed.role.arn")
_AZURE = re.compile(r"fs\.azure\.account\.key\.([^.]+)\.(?:dfs|blob)\.core\.windows\.net")
_BUCKET = re.compile(r"fs\.s3a\.bucket\.[^.]+\.(?:" + "|".join(map(re.escape, _S3)) + ")")


def settings(spark: SparkSession) -> dict[str, str]:
    """What workers need of the session's Hadoop configuration; nothing else leaves the driver."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {f"fs.s3a.{k}": v for k in _S3 if (v := conf.get(f"fs.s3a.{k}"))}
    entries = conf.iterator()
    while entries.hasNext():
        name = entries.next().getKey()
        if _AZURE.fullmatch(name) or _BUCKET.fullmatch(name):
            out[name] = conf.get(name)
    if found := conf.get("fs.gs.auth.access.token"):
        out["fs.gs.auth.access.token"] = found
    return out


def arguments(uri: str, known: dict[str, str]) -> tuple[str, dict, str]:
    """Kind of the store (local, s3, azure, gcs or other), its arguments, and the path in it."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):/+(.*)$", uri)
    if not m:
        return "local", {}, uri
    scheme, rest = m[1].lower(), m[2]
    if scheme == "file":
        return "local", {}, "/" + rest
    if scheme in ("s3", "s3a", "s3n"):
        bucket = rest.partition("/")[0]
        own = lambda key: known.get(f"fs.s3a.bucket.{bucket}.{key}") or known.get(f"fs.s3a.{key}")
        out = {"access_key": own("access.key"), "secret_key": own("secret.key"), "session_token": own("session.token"), "region": own("endpoint.region"), "role_arn": own("assumed.role.arn")}
        if endpoint := own("endpoint"):
            plain = endpoint.startswith("http://") or (own("connection.ssl.enabled") == "false" and "://" not in endpoint)
            out |= {"endpoint_override": endpoint.split("://")[-1].rstrip("/"), "scheme": "http" if plain else "https", "force_virtual_addressing": own("path.style.access") != "true"}
        return "s3", {k: v for k, v in out.items() if v is not None}, rest
    if scheme in ("abfs", "abfss", "wasb", "wasbs"):
        host, _, path = rest.partition("/")
        container, _, account = host.rpartition("@")
        account = account.partition(".")[0]
        key = next((v for k, v in known.items() if (a := _AZURE.fullmatch(k)) and a[1] == account), None)
        return "azure", {"account_name": account} | ({"account_key": key} if key else {}), f"{container}/{path}"
    if scheme == "gs":
        return "gcs", {"access_token": known["fs.gs.auth.access.token"]} if "fs.gs.auth.access.token" in known else {}, rest
    return "other", {}, uri


def open_store(uri: str, known: dict[str, str]) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it. Paths are Hadoop's: without escapes."""
    kind, given, path = arguments(uri, known)
    if kind == "local":
        return pafs.LocalFileSystem(), path
    if kind == "s3":
        return pafs.S3FileSystem(**given), path
    if kind == "azure":
        return pafs.AzureFileSystem(**given), path
    if kind == "gcs":
        from datetime import datetime, timedelta, timezone

        return pafs.GcsFileSystem(**given, **({"credential_token_expiration": datetime.now(timezone.utc) + timedelta(hours=1)} if given else {})), path
    system, inner = pafs.FileSystem.from_uri(uri)
    return system, unquote(inner)
