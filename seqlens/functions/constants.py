"""Fixed values.

These must equal the values the original reports use, or the results differ.
They are stated here once, as plain text, and imported everywhere else.
"""

# --- fixed values (must match the original analysis) -----------------------

# Lowercase hex alphabet used by the positional score decode.
HEX_ALPHABET = "0123456789abcdef"
# Score strings are "0x" followed by this many hex digits (u64).
SCORE_HEX_DIGITS = 16
# Addresses are compared as "0x" followed by this many hex digits.
ADDRESS_HEX_DIGITS = 64

# Official scope of a game.
OFFICIAL_SETTINGS_ID = 1
OFFICIAL_MINTER = "0x0000000000000006"
# Address of the official minter, resolved to OFFICIAL_MINTER by the registry.
OFFICIAL_MINTER_ADDRESS = "0x00a67ef20b61a9846e1c82b411175e6ab167ea9f8632bd6c2091823c3629ec42"

# Valid score range, inclusive.
VALID_SCORE_MIN = 1
VALID_SCORE_MAX = 3000

# Experience tiers by the player's Nth game: (inclusive upper bound, label), then the rest.
EXPERIENCE_TIERS = [(1, "1st game"), (5, "2nd-5th game"), (20, "6th-20th game"),
                    (50, "21st-50th game")]
EXPERIENCE_REST = "51st+ game"

# Minimum players per ordinal in the learning curves.
LEARNING_CURVE_MIN_PLAYERS = 30
# Minimum games per player in the within-player report.
WITHIN_PLAYER_MIN_GAMES = 10
# First K games for the cohort comparison.
COHORT_FIRST_K = 3
COHORT_MEMBER = "og_veteran"
COHORT_OTHER = "genuinely_new"

# Skill persistence: players with at least this many games, tiered on their
# first EARLY games into K tiers, followed over later windows
# (inclusive upper bounds of the ordinal) up to the last bound.
PERSISTENCE_MIN_GAMES = 20
PERSISTENCE_EARLY_GAMES = 10
PERSISTENCE_TIERS = 4
PERSISTENCE_WINDOWS = [20, 40, 70, 120]

# Mint-event enumeration of the earlier game's players.
OG_CONTRACT = "0x018108b32cea514a78ef1b0e4a0753e855cdf620bc0565202c02456f618c4dc4"
TRANSFER_SELECTOR = "0x99cd8bde557814842a3121e8ddfd433a539b8c9f14bf31ebf108d12e6196e9"
MINT_FROM = "0x0"
MINT_FROM_BLOCK = 700_000
MINT_TO_BLOCK = 1_700_000
