"""Registered queries, their oracles and the derived inputs they read."""
