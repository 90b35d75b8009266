"""termweave """
