"""Request signatures of AWS, version 4."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import parse_qsl, quote, urlsplit


@dataclass(frozen=True)
class Credentials:
    access_key: str
    secret_key: str
    session_token: str = ""

    @classmethod
    def of_environment(cls) -> Credentials:
        return cls(os.environ["AWS_ACCESS_KEY_ID"], os.environ["AWS_SECRET_ACCESS_KEY"], os.environ.get("AWS_SESSION_TOKEN", ""))


def signed(method: str, url: str, headers: dict[str, str], body: bytes, region: str, service: str, credentials: Credentials | Callable[[], Credentials], now: datetime | None = None) -> dict[str, str]:
    """The headers with those that sign the request. credentials: or what gives fresh ones."""
    known = credentials() if callable(credentials) else credentials
    parts, moment = urlsplit(url), (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    out = {k: v for k, v in headers.items() if k.lower() != "authorization"} | {"host": parts.netloc, "x-amz-date": moment}
    if known.session_token:
        out["x-amz-security-token"] = known.session_token
    digest = hashlib.sha256(body).hexdigest()
    lower = sorted((k.lower(), " ".join(v.split())) for k, v in out.items())
    names = ";".join(k for k, _ in lower)
    escaped = lambda s: quote(s, safe="-_.~")
    query = "&".join(f"{a}={b}" for a, b in sorted((escaped(k), escaped(v)) for k, v in parse_qsl(parts.query, keep_blank_values=True)))
    request = "\n".join([method, quote(parts.path or "/", safe="/-_.~"), query, *(f"{k}:{v}" for k, v in lower), "", names, digest])
    scope = f"{moment[:8]}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", moment, scope, hashlib.sha256(request.encode()).hexdigest()])
    key = f"AWS4{known.secret_key}".encode()
    for part in (moment[:8], region, service, "aws4_request"):
        key = hmac.digest(key, part.encode(), "sha256")
    signature = hmac.digest(key, text.encode(), "sha256").hex()
    out.pop("host")  # the client sets it
    return out | {"Authorization": f"AWS4-HMAC-SHA256 Credential={known.access_key}/{scope}, SignedHeaders={names}, Signature={signature}"}
