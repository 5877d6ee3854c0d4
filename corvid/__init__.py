"""corvid: a text-retrieval and chat-store analytics engine written as Spark plans."""
