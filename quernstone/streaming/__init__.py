"""The same counts over streams."""

from quernstone.streaming.followers import follower_count_stream, windowed_follower_count

__all__ = ["follower_count_stream", "windowed_follower_count"]
