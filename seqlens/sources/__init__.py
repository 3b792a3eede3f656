from seqlens.sources import fixture, readers, schemas, sinks

__all__ = ["fixture", "readers", "schemas", "sinks"]
