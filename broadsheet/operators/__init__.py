"""DataFrame to DataFrame operators; each says in its text what it shuffles."""
