from fieldspark.cli import main

raise SystemExit(main())
