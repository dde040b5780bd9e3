"""sluice: feed and item processing on Spark DataFrames.

The node types of a flow description map to these functions; each takes
and returns a ``Feed`` (a DataFrame plus its item order).
"""

from .feed import Feed, OrderKey
from .operators.fields import map_fields, regex_replace, truncate
from .operators.filter import filter_items
from .operators.limit import limit_items
from .operators.merge import merge
from .operators.sort import sort_items
from .plans.flow import FlowError, register, run_flow, validate
from .session import get_session
from .sinks.documents import json_envelope, rss_document, rss_fragments, webhook_payloads, write_json_lines
from .sinks.versions import latest_versions, published_outputs, read_published, save_output
from .sources.feed_source import feed_items, feed_summary
from .sources.files import landed_documents
from .sources.json_source import json_items

__all__ = [
    "Feed", "OrderKey", "FlowError", "feed_items", "feed_summary", "filter_items", "get_session",
    "json_envelope", "json_items", "landed_documents", "latest_versions", "limit_items", "map_fields",
    "merge", "published_outputs", "read_published", "regex_replace", "register", "rss_document",
    "rss_fragments", "run_flow", "save_output", "sort_items", "truncate", "validate", "webhook_payloads",
    "write_json_lines",
]
