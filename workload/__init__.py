"""The registered queries: test tables mapped to an event log, and their SQL oracle."""
