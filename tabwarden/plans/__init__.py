"""End-to-end plans: sessions, durable intermediates, screening, batches."""
