"""Fetching documents by address: only public hosts, every hop checked again, sizes bounded. Runs where it is called, or over a DataFrame."""

from __future__ import annotations

import http.client
import ipaddress
import re
import socket
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import ConvertError

#: Hops that are followed, bytes of an answer, seconds to wait.
HOPS, BYTES_MAX, WAIT = 5, 128 << 20, 30


def blocked(address: str) -> bool:
    """Addresses that aren't public: private, loopback, link-local, unspecified, broadcast, documentation, multicast and mapped ones of these."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not ip.is_global or ip.is_multicast


def resolve(host: str, port: int) -> list[str]:
    return sorted({i[4][0] for i in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})


def check_address(url: str, lookup: Callable[[str, int], list[str]] = resolve) -> tuple[str, str, int, str]:
    """(scheme, host, port, address to connect to) of a public http address; raises otherwise."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ConvertError("INVALID_URL", "only http and https addresses are fetched")
    port = u.port or (443 if u.scheme == "https" else 80)
    try:
        found = lookup(u.hostname, port)
    except OSError as x:
        raise ConvertError("FETCH_FAILED", f"{u.hostname}: {x}") from None
    if not found or any(blocked(a) for a in found):
        raise ConvertError("BLOCKED_ADDRESS", f"{u.hostname} isn't a public host")
    return u.scheme, u.hostname, port, found[0]


class Pinned(http.client.HTTPSConnection):
    """A connection to the address that was checked, for the host that was asked for."""

    def __init__(self, host: str, port: int, address: str, secure: bool):
        super().__init__(host, port, timeout=WAIT)
        self.address, self.secure = address, secure

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)
        if self.secure:
            self.sock = self._context.wrap_socket(self.sock, server_hostname=self.host)


def ask(url: str, where: tuple[str, str, int, str]) -> tuple[int, dict[str, str], Iterator[bytes]]:
    """(status, headers in lower case, pieces of the body) of one request."""
    scheme, host, port, address = where
    u = urlsplit(url)
    c = Pinned(host, port, address, scheme == "https")
    c.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"Accept": "*/*"})
    r = c.getresponse()
    return r.status, {k.lower(): v for k, v in r.getheaders()}, iter(lambda: r.read(1 << 16), b"")


def name_of(url: str, headers: dict[str, str]) -> str:
    """The file's name by the answer, else the address' last part, else a stock name."""
    m = re.search(r"filename=\"?([^\";]+)\"?", headers.get("content-disposition", ""), re.I)
    name = (m[1] if m else unquote(urlsplit(url).path.rsplit("/", 1)[-1])).strip().rsplit("/", 1)[-1]
    return name if name and name not in (".", "..") and "\0" not in name else "download.bin"


def fetch_url(url: str, most: int = BYTES_MAX, lookup: Callable = resolve, request: Callable = ask) -> tuple[bytes, str, str]:
    """(bytes, file name, media type). Redirects are followed by hand, their hosts checked like the first."""
    for _ in range(HOPS + 1):
        status, headers, body = request(url, check_address(url, lookup))
        if status in (301, 302, 303, 307, 308):
            if "location" not in headers:
                raise ConvertError("FETCH_FAILED", "a redirect to nowhere")
            url = urljoin(url, headers["location"])
            continue
        if status != 200:
            raise ConvertError("FETCH_FAILED", f"status {status}")
        if headers.get("content-length", "0").isdigit() and int(headers.get("content-length", "0")) > most:
            raise ConvertError("resourceLimit", "the answer is too large")
        data = bytearray()
        for part in body:
            data += part
            if len(data) > most:
                raise ConvertError("resourceLimit", "the answer is too large")
        return bytes(data), name_of(url, headers), headers.get("content-type", "application/octet-stream").split(";")[0].strip()
    raise ConvertError("FETCH_FAILED", "too many redirects")


def fetch(urls: DataFrame, key: str = "doc_id", url: str = "url", most: int = BYTES_MAX, lookup: Callable = resolve, request: Callable = ask) -> DataFrame:
    """(key, file_name, media_type, data, error_code) of each address; null addresses give the code INVALID_URL."""
    recs = urls.select(F.col(key).alias("__k"), F.col(url).alias("__u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u in pdf.itertuples(index=False, name=None):
                try:
                    data, name, kind = fetch_url(u or "", most, lookup, request)
                    rows.append((k, name, kind, data, None))
                except ConvertError as x:
                    rows.append((k, None, None, None, x.code))
                except (OSError, http.client.HTTPException, ValueError):
                    rows.append((k, None, None, None, "FETCH_FAILED"))
            yield pd.DataFrame(rows, columns=["__k", "file_name", "media_type", "data", "error_code"]).astype(object)

    return recs.mapInPandas(run, f"__k {recs.schema['__k'].dataType.simpleString()}, file_name string, media_type string, data binary, error_code string").withColumnRenamed("__k", key)
