"""Table definitions, sessions, versioned storage."""
