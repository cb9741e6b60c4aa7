"""Reading and writing: files, databases, message queues, Python sources."""
