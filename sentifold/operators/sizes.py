"""What may be broadcast."""

# Rows of a narrow dimension that every executor may hold (a few MB).
BROADCAST_ROWS = 50_000
