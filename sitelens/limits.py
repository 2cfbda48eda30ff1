"""Capture limits.

Every limit is a parameter.  Those of a page shape *what a facts row stores*;
whatever is clipped is reported in the field's ``limits`` struct.  Checks read
the stored meta texts, alternates and JSON-LD, so these are whole unless a limit
is asked for; heading samples, inventories and URLs of display are bounded.
Links, images, counts, text hashes and similarity always use the whole page.

Limits of robots files and sitemaps are off unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
UNLIMITED = 2_147_483_647


@dataclass(frozen=True)
class CaptureLimits:
    string_chars: int = UNLIMITED
    url_chars: int = 8_192
    meta_items: int = UNLIMITED
    alternate_items: int = UNLIMITED
    jsonld_chars: int = UNLIMITED
    jsonld_scripts: int = UNLIMITED
    heading_samples: int = 5
    link_inventory: int = 200
    image_inventory: int = 100
    snapshot_chars: int = UNLIMITED
    session_chars: int = 1_500_000
    jsonld_nodes: int = UNLIMITED
    jsonld_depth: int = UNLIMITED


@dataclass(frozen=True)
class NetworkLimits:
    redirects: int = 10
    body_bytes: int = 512_000
    header_chars: int = UNLIMITED
    url_chars: int = 8_192


@dataclass(frozen=True)
class RobotsLimits:
    """Off unless asked for: a larger body is refused, further lines are passed over with a diagnostic."""

    body_bytes: int | None = None
    lines: int | None = None


@dataclass(frozen=True)
class SitemapLimits:
    """Off unless asked for: they protect a browser tab, not a cluster.  Files past
    ``depth`` or ``files`` are marked, not lost; a body past ``body_bytes`` is refused."""

    depth: int | None = None
    files: int | None = None
    entries: int | None = None
    body_bytes: int | None = None


DEFAULT_CAPTURE = CaptureLimits()
DEFAULT_NETWORK = NetworkLimits()
DEFAULT_ROBOTS = RobotsLimits()
DEFAULT_SITEMAP = SitemapLimits()
