from mendseq.cli import main

raise SystemExit(main())
