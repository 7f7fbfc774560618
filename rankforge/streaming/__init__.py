"""No streaming operators exist in this engine's domain; batch frames only."""
