from seqlens.functions.scalars import (bucketize, decode_hex_score, encode_address,
                                      encode_hex_score, normalise_address, ntile_of_position,
                                      short_hex)

__all__ = ["bucketize", "decode_hex_score", "encode_address", "encode_hex_score",
           "normalise_address", "ntile_of_position", "short_hex"]
