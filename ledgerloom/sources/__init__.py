"""Readers of statements, exports, rent rolls, trackers and journals."""
