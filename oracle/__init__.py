"""SQL twins of the registered queries, for DuckDB."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle.claims_sql import SQL as claims
    from oracle.text_sql import SQL as text

    # the cube's outputs are those of the claims, the index finds what the scan finds
    same = {"cube_kpis": "kpis", "cube_themes": "theme_table", "cube_segments": "segments_all_dims", "cube_stages": "journey_stages",
            "cube_daily": "daily_overview", "cube_daily_themes": "daily_by_theme", "claim_search_indexed": "claim_search"}
    return {**claims, **text, **{name: claims[of] for name, of in same.items()}}
