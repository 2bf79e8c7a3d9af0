"""Queries over the given tables, one module per operator family."""


def load():
    """Import every query module and return the registry."""
    from vakanz.plans import (  # noqa: F401
        listing_queries,
        page_queries,
        preference_queries,
        profile_queries,
        report_queries,
        registry,
        resume_queries,
        score_queries,
        source_queries,
        stream_queries,
        text_queries,
    )

    return registry
