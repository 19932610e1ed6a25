"""Numbers from the environment, and addresses that must be local."""

from __future__ import annotations

import ipaddress
import os
import re
from collections.abc import Iterable
from urllib.parse import parse_qsl, urlsplit


class NonLocalEndpointError(ValueError):
    """An address leaves this machine."""


def _number(name: str, default, kind):
    raw = os.environ.get(name)
    try:
        return default if raw is None or not raw.strip() else kind(raw)
    except ValueError as e:
        raise ValueError(f"{name} must be a number, not {raw!r}") from e


def int_env(name: str, default: int) -> int:
    return _number(name, default, int)


def float_env(name: str, default: float) -> float:
    return _number(name, default, float)


def is_loopback_host(host: str) -> bool:
    name = host.strip("[]").rstrip(".").lower()
    if name == "localhost":
        return True
    try:
        return ipaddress.ip_address(name.split("%")[0]).is_loopback
    except ValueError:
        return False


def is_local_socket_path(host: str) -> bool:
    """An absolute path that does not climb."""
    return host.startswith("/") and ".." not in host.split("/")


def require_loopback_host(host: str, *, what: str = "host") -> str:
    if not is_loopback_host(host):
        raise NonLocalEndpointError(f"{what} {host!r} is not on this machine")
    return host


def require_loopback_url(url: str, *, what: str = "URL") -> str:
    require_loopback_host(urlsplit(url).hostname or "", what=what)
    return url


#: Keys of a connection that name its hosts, and those that hand the choice to a service file. Fixed values of the client library.
HOST_KEYS, SERVICE_KEYS = ("host", "hostaddr"), ("service", "servicefile")
#: ``key = value`` of a connection string; values may be quoted.
_SETTING = re.compile(r"(\w+)\s*=\s*('(?:[^'\\]|\\.)*'|\S*)")


def _leaves(hosts: str, *, sockets: bool) -> bool:
    """Whether any host of a comma list is elsewhere; empty ones mean the default, which is here."""
    named = [h for h in map(str.strip, hosts.split(",")) if h]
    return not all(is_loopback_host(h) or sockets and is_local_socket_path(h) for h in named)


def _settings_leave(settings: Iterable[tuple[str, str]]) -> bool:
    return any(key in SERVICE_KEYS or key in HOST_KEYS and _leaves(value, sockets=True) for key, value in ((k.lower(), v) for k, v in settings) if value)


def _authority_leaves(authority: str) -> bool:
    """Whether the authority of a URI names any host elsewhere, or none at all.

    The first ``@`` ends the credentials, as for the client library; another one, or a backslash, may be read in two ways.
    """
    credentials, at, rest = authority.partition("@")
    hosts = [h for h in map(str.strip, (rest if at else credentials).split(",")) if h]
    bare = [re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*)(:\d*)?", h) for h in hosts]
    return "\\" in authority or not hosts or not all(m and is_loopback_host(m[1]) for m in bare)


#: A driver prefix and the schemes after it, up to an authority; and databases that live in a file or in memory. Fixed values.
_DRIVER = re.compile(r"(?i)\s*jdbc:(?:[a-z][\w+.-]*:)*//")
_EMBEDDED = re.compile(r"(?i)\s*jdbc:(sqlite|duckdb|derby(?!:/*\w+:)|h2:(file|mem)|hsqldb:(file|mem)):")


def _driver_leaves(uri: str) -> bool:
    """Whether a driver's connection string names a host elsewhere; what names neither a host nor an embedded database may do so."""
    found = _DRIVER.match(uri)
    if not found:
        return _EMBEDDED.match(uri) is None
    address, _, settings = uri[found.end() :].partition(";")
    parts = urlsplit(f"driver://{address}")
    more = [tuple(x.split("=", 1)) for x in settings.split(";") if "=" in x]
    return _authority_leaves(parts.netloc) or _settings_leave([*parse_qsl(parts.query), *more])


def require_local_uri(uri: str, *, what: str = "URI") -> str:
    """``uri`` if all that it names is on this machine; else, and where that cannot be told, ``NonLocalEndpointError``.

    A URI with an authority needs loopback hosts there and in the query keys that override them. A connection string of
    ``key=value`` settings needs loopback hosts or local sockets. A driver's string (``jdbc:``) needs loopback hosts, or a database
    in a file or in memory. Either must not name a service file. Anything else is a local
    path, unless it begins as a network share does, or is the bare scheme of a database whose host the environment would choose.
    """
    try:
        parts = urlsplit(uri)
        if uri.strip().lower().startswith("jdbc:"):
            leaves = _driver_leaves(uri)
        elif parts.netloc:
            leaves = _authority_leaves(parts.netloc) or _settings_leave(parse_qsl(parts.query))
        elif "=" in uri:
            leaves = _settings_leave((k, v.strip("'\"")) for k, v in _SETTING.findall(uri))
        else:
            leaves = parts.scheme in ("postgres", "postgresql") or re.match(r"\s*[\\/]{2}", uri) is not None
    except ValueError:
        leaves = True
    if leaves:
        raise NonLocalEndpointError(f"{what} leaves this machine")
    return uri


def redact_credentials(text: str) -> str:
    """Passwords in URIs and in key=value connection strings become stars."""
    text = re.sub(r"(?i)(\w[\w+.-]*://[^:/@\s]*):[^@\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)\b(password|passwd|pwd)\s*=\s*('[^']*'|\S+)", r"\1=***", text)
