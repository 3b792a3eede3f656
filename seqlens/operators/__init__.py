from seqlens.operators.cohorts import (drop_members, mint_players, mint_receivers, mint_summary,
                                      overlap, overlap_counts, scope_players, tag_members)
from seqlens.operators.games import (first_games, game_sequence, is_valid, official_games,
                                     scoped_games, scoped_metadata, sequenced_games, valid)
from seqlens.operators.median import grouped_median, median_of
from seqlens.operators.quality import (address_quality, duplicate_tokens, key_uniqueness,
                                       score_quality, sequence_load)
from seqlens.operators.ranking import global_positions, quantile_tiers
from seqlens.operators.reuse import EntityTable, entity_table, per_entity
from seqlens.operators.sequence import first_k, latest_per_key, sequence

__all__ = ["drop_members", "mint_players", "mint_receivers", "mint_summary", "overlap", "overlap_counts",
           "scope_players", "tag_members", "first_games", "game_sequence", "is_valid", "official_games",
           "scoped_games", "scoped_metadata", "sequenced_games", "valid", "grouped_median", "median_of",
           "address_quality", "duplicate_tokens", "key_uniqueness", "score_quality", "sequence_load", "global_positions",
           "quantile_tiers", "EntityTable", "entity_table", "per_entity", "first_k", "latest_per_key", "sequence"]
