"""Sources: the driver's tables and generators, and adapters to brokers and services through injected clients."""
