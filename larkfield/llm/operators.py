"""All operators, so that one import tells whether the subpackage can be used."""

from larkfield.llm import (  # noqa: F401
    decontaminate, html_extract, importance, line_quality, mixing, packing, quality_nbsvm, sharding, simhash, substring_dedup, toxicity, url_filter,
)
